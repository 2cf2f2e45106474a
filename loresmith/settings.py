"""Settings from the environment, validated when they are made."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

_CHOICES = {"log_level": ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), "log_format": ("json", "text", "pretty"), "llm_provider": ("local", "openrouter"), "local_llm_type": ("ollama", "lmstudio")}


@dataclass(frozen=True)
class Settings:
    api_host: str = "0.0.0.0"
    api_port: int = 8000
    api_prefix: str = "/api/v1"
    scraping_interval_hours: int = 6
    max_posts_per_scrape: int = 100
    scraping_delay_seconds: float = 2.0
    log_level: str = "INFO"
    log_format: str = "pretty"
    models_dir: str = "models"
    llm_provider: str = "local"
    openrouter_api_key: str | None = None
    openrouter_model: str = "anthropic/claude-3-haiku"
    local_llm_url: str = "http://localhost:11434"
    local_llm_model: str = "llama3"
    local_llm_type: str = "ollama"
    llm_processing_enabled: bool = True
    llm_quality_threshold: float = 0.6
    local_llm_max_context: int | None = None
    local_llm_optimal_chunk: int | None = None
    llm_timeout_seconds: float = 120.0
    local_llm_timeout_seconds: float | None = None

    def __post_init__(self):
        for name, allowed in _CHOICES.items():
            value = getattr(self, name)
            if value.lower() not in {a.lower() for a in allowed}:
                raise ValueError(f"{name} is {value!r}; it can be {', '.join(allowed)}")
            object.__setattr__(self, name, value.upper() if name == "log_level" else value.lower())
        if not 0.0 <= self.llm_quality_threshold <= 1.0:
            raise ValueError("llm_quality_threshold lies between 0 and 1")
        if not 0 < self.api_port < 65536:
            raise ValueError("api_port lies between 1 and 65535")
        if self.llm_provider == "openrouter" and not (self.openrouter_api_key or "").startswith("sk-or-"):
            raise ValueError("openrouter_api_key is needed with openrouter and starts with sk-or-")

    @property
    def timeout(self) -> float:
        """Seconds for a model's answer."""
        own = self.local_llm_timeout_seconds if self.llm_provider == "local" else None
        return self.llm_timeout_seconds if own is None else own

    @property
    def context(self) -> tuple[int, int]:
        """(context tokens, chunk size) of the local model: as set, else small ones."""
        if self.local_llm_max_context:
            return self.local_llm_max_context, self.local_llm_optimal_chunk or self.local_llm_max_context // 4
        return 2048, 500


def has_credentials(settings: Settings, source: str, env: dict[str, str] | None = None) -> bool:
    """Whether a source can be asked: the hosted model by its key, a live site by its variables in the environment."""
    env = dict(os.environ if env is None else env)
    if source == "openrouter":
        return bool(settings.openrouter_api_key)
    wanted = {"reddit": ("REDDIT_CLIENT_ID", "REDDIT_CLIENT_SECRET"), "github": ("GITHUB_TOKEN",)}.get(source, ())
    return all(env.get(k) for k in wanted)


def load(env: dict[str, str] | None = None) -> Settings:
    """Settings by upper- or lower-case variable names; what is not set keeps its default."""
    env = {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    given = {}
    for f in fields(Settings):
        if f.name in env:
            raw, kind = env[f.name], str(f.type)
            given[f.name] = raw.lower() in ("1", "true", "yes") if "bool" in kind else float(raw) if "float" in kind else int(raw) if "int" in kind else raw
    return Settings(**given)
