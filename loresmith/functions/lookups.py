"""Word lists, aliases, templates and defaults, and the small tables made of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: what tells a service from an article
SKIP_WORDS = (
    "tutorial", "guide", "paper", "book", "course", "awesome", "list", "collection", "article", "news", "blog", "post", "story", "report",
    "analysis", "review", "opinion", "party", "craze", "trend", "revolution", "gold rush", "heralds", "announcement", "release", "sparks", "transform",
)
ARTICLE_PHRASES = ("article", "op-ed", "announcement", "examination of", "summarizing", "comprehensive look", "explores", "discusses", "argues")
ARTICLE_URLS = ("/blog/", "/news/", "/article/", "medium.com", "arxiv.org", "youtube.com")
SERVICE_URLS = (".ai", ".io", "api.", "app.", "platform.", "cloud.", "huggingface.co", "openai.com", "anthropic.com", "cohere.com", "replicate.com", "stability.ai", "github.com/.*api", "github.com/.*sdk")
STRONG_WORDS = ("api", "sdk", "platform", "model api", "inference service", "provides access to", "api for")

# --- fixed values: categories by keyword; (category, in the name, in name and description)
CATEGORY_RULES = (
    ("video", ("synthesia", "heygen", "runway", "pika", "pictory", "fliki", "invideo", "luma", "kaiber", "genmo", "hour one", "deepbrain", "colossyan", "elai", "steve.ai", "rephrase", "d-id"),
     ("video", "animation", "motion graphics", "movie", "film", "footage")),
    ("audio", ("elevenlabs", "eleven labs", "murf", "play.ht", "wellsaid", "resemble", "descript", "overdub", "respeecher", "sonantic"),
     ("audio", "voice", "speech", "music", "sound", "tts", "text-to-speech", "voice synthesis", "voice clone", "podcast", "transcription")),
    ("image", ("dall-e", "midjourney", "stable diffusion", "leonardo", "ideogram", "dreamstudio", "nightcafe", "artbreeder", "deep dream"),
     ("image", "picture", "photo", "art", "drawing", "illustration", "graphic", "visual", "paint", "design", "artwork")),
    ("code", ("copilot", "codeium", "cursor", "tabnine", "codex", "replit"),
     ("code", "programming", "developer", "ide", "compiler", "debugger", "repository", "github", "coding assistant")),
    ("multimodal", (), ("multimodal", "vision", "multi-modal", "image and text", "vision language", "vlm", "visual language")),
    ("text", ("openai", "anthropic", "claude", "gpt", "mistral", "llama", "gemini", "palm", "character.ai", "replika"),
     ("llm", "language model", "chatbot", "chat assistant", "gpt", "claude", "writing assistant", "text generation", "conversation")),
)
NOT_TEXT = ("text-to-video", "text-to-image", "text-to-speech", "text-to-audio")
FALLBACK_CATEGORIES = (
    ("image", ("midjourney", "dall-e", "stable diffusion", "leonardo", "ideogram")),
    ("video", ("runway", "pika", "luma", "kaiber", "genmo", "haiper")),
    ("audio", ("elevenlabs", "eleven labs", "murf", "play.ht", "wellsaid", "descript")),
    ("text", ("gpt", "claude", "llama", "gemini", "mistral")),
    ("code", ("copilot", "cursor", "codeium", "tabnine")),
)
PATTERN_CATEGORIES = (
    ("text", ("gpt", "claude", "llama", "qwen", "phi", "gemma", "mistral", "deepseek", "falcon", "hunyuan", "glm", "ernie", "kimi", "coder", "starcoder", "codellama", "devstral", "miniCPM")),
    ("image", ("stable-diffusion", "sd", "midjourney", "mj", "dalle", "dall-e", "imagen", "flux", "qwen-image", "QWEN-IMAGE")),
    ("video", ("wan", "sora", "runway", "pika", "stable-video", "svd", "cogvideo", "animatediff")),
    ("audio", ("whisper", "bark", "musicgen", "audiogen", "elevenlabs", "11labs", "tortoise")),
    ("multimodal", ("gpt-4v", "gpt4v", "vision", "llava", "blip", "clip", "gemini", "omni", "o1", "o3", "o4")),
)

# --- fixed values: spellings of services, in order of declaration
VARIATIONS = (
    ("elevenlabs", ("eleven labs", "elevenlabs", "eleven-labs", "ElevenLabs", "Eleven Labs")),
    ("heygen", ("heygen", "hey gen", "hey-gen", "HeyGen", "Hey Gen")),
    ("stablediffusion", ("stable diffusion", "stablediffusion", "stable-diffusion", "StableDiffusion")),
    ("midjourney", ("midjourney", "mid journey", "mid-journey", "MidJourney", "Mid Journey")),
    ("characterai", ("character.ai", "character ai", "characterai", "character-ai", "Character.AI")),
    ("githubcopilot", ("github copilot", "githubcopilot", "github-copilot", "copilot", "Copilot")),
    ("openai", ("openai", "open ai", "open-ai", "OpenAI", "Open AI")),
    ("anthropic", ("anthropic", "claude", "Claude", "Anthropic")),
    ("huggingface", ("huggingface", "hugging face", "hugging-face", "HuggingFace", "HF")),
    ("scaleai", ("scale ai", "scaleai", "scale-ai", "Scale AI", "Scale.AI")),
    ("replicastudios", ("replica studios", "replicastudios", "replica-studios", "Replica Studios")),
    ("playht", ("play.ht", "playht", "play-ht", "Play.ht", "PlayHT")),
    ("wellsaidlabs", ("wellsaid", "wellsaid labs", "wellsaidlabs", "WellSaid Labs", "WellSaid")),
    ("deepbrain", ("deepbrain", "deep brain", "deep-brain", "DeepBrain", "Deep Brain AI")),
    ("synthesia", ("synthesia", "Synthesia")),
    ("did", ("d-id", "did", "D-ID", "D-id")),
    ("runway", ("runway", "runway ml", "runwayml", "Runway", "RunwayML")),
    ("pika", ("pika", "pika labs", "pikalabs", "Pika", "Pika Labs")),
    ("leonardo", ("leonardo", "leonardo ai", "leonardoai", "Leonardo", "Leonardo.AI")),
    ("ideogram", ("ideogram", "ideogram ai", "ideogramai", "Ideogram", "Ideogram.AI")),
    ("cursor", ("cursor", "cursor ai", "cursorai", "Cursor", "Cursor AI")),
    ("codeium", ("codeium", "Codeium")),
    ("luma", ("luma", "luma ai", "lumaai", "luma labs", "lumalabs", "Luma", "Luma Labs")),
    ("kaiber", ("kaiber", "kaiber ai", "kaiberai", "Kaiber", "Kaiber.AI")),
    ("genmo", ("genmo", "genmo ai", "genmoai", "Genmo", "Genmo.AI")),
    ("haiper", ("haiper", "haiper ai", "haiperai", "Haiper", "Haiper.AI")),
    ("moonvalley", ("moonvalley", "moon valley", "moon-valley", "MoonValley", "Moon Valley")),
    ("neuralframes", ("neural frames", "neuralframes", "neural-frames", "Neural Frames")),
    ("immersity", ("immersity", "immersity ai", "immersityai", "Immersity", "Immersity.AI")),
    ("leiapix", ("leiapix", "leia pix", "leia-pix", "LeiaPix", "Leia Pix")),
    ("depthlab", ("depthlab", "depth lab", "depth-lab", "DepthLab", "Depth Lab")),
)
MODEL_ALIASES = {
    "qwen3": "Qwen3", "qwen-3": "Qwen3", "qwen3-coder": "Qwen3-Coder", "qwen3-coder-flash": "Qwen3-Coder-Flash", "qwen3coder": "Qwen3-Coder", "qwen": "Qwen3",
    "phi-4": "Phi-4", "phi4": "Phi-4", "phi-3": "Phi-3", "phi3": "Phi-3", "phi-3.1": "Phi-3.1",
    "llama3": "llama-3", "llama-3.2": "llama-3", "llama3.2": "llama-3", "llama-3-70b": "llama-3", "llama-3-8b": "llama-3",
    "gpt4": "gpt-4", "gpt-4": "gpt-4", "gpt5": "gpt-5", "gpt-5": "gpt-5", "chatgpt": "ChatGPT",
    "claude3": "claude-3", "claude-3": "claude-3", "claude-3-opus": "Claude 3 Opus", "claude": "claude-3",
    "deepseek": "Deepseek", "deepseek-v3": "Deepseek v3", "deepseekcoder": "DeepCoder", "hunyuan": "Hunyuan", "hunyuan-80b": "Hunyuan-80B-A13B",
    "wan": "wan2.2", "wan2": "wan2.2", "wan-2.2": "wan2.2", "sora": "Sora", "sd": "stable-diffusion", "mj": "midjourney",
}
PRIORITY_NAMES = (
    "heygen", "synthesia", "elevenlabs", "eleven labs", "runway", "leonardo", "midjourney", "d-id", "pika", "luma", "replika", "character.ai",
    "spatialos", "unity cloud", "soul machines", "murf", "play.ht", "ideogram", "github copilot", "cursor", "codeium", "scale ai",
    "glambase", "wav2lip", "rephrase.ai", "hour one", "deepbrain", "synthetically", "colossyan", "elai", "steve.ai", "pictory",
    "invideo", "fliki", "wellsaid", "resemble", "descript", "overdub", "respeecher", "sonantic", "replica studios",
    "kaiber", "genmo", "lumalabs", "haiper", "moonvalley", "neural frames", "immersity", "leiapix", "depthlab",
)
QUERY_TEMPLATES = (
    ("cost", ('"{service}" price per month', '"{service}" credits cost', '"{service}" tier pricing', '"{service}" free limit')),
    ("optimization", ('"{service}" config settings', '"{service}" parameters temperature', '"{service}" system prompt', '"{service}" model selection')),
    ("technical", ('"{service}" API key', '"{service}" rate limit daily', '"{service}" context window', '"{service}" max tokens')),
    ("workarounds", ('"{service}" bypass limit', '"{service}" unlimited hack', '"{service}" Azure credits', '"{service}" alternative API')),
    ("bugs", ('"{service}" bug fix', '"{service}" not working', '"{service}" error message', '"{service}" crashes when')),
)
SEARCH_BASE = "https://old.reddit.com/search?q="

# --- fixed values: scoring, filtering and rendering words
RELEVANT_WORDS = ("prompt", "prompting", "best practice", "tip", "trick", "parameter", "setting", "config", "guide", "how to", "optimal", "recommended", "avoid", "mistake", "pitfall")
SOURCE_WEIGHTS = (("official_docs", 1.0), ("github", 0.9), ("reddit", 0.7), ("discord", 0.6), ("forum", 0.7), ("blog", 0.5))
SPECIFIC = (r"\d+", r"`[^`]+`", r'"[^"]+"', r"parameter|config|setting", r"version|v\d+")
ACTIONS = ("use", "set", "configure", "enable", "disable", "add", "remove", "modify", "change", "update", "should", "must", "need", "require", "recommend")
MONEY_WORDS = ("save", "cheap", "free", "cost", "price", "credit", "limit", "tier", "plan")
PROBLEM_KINDS = (
    ("technical", ("api", "stutter", "error", "bug", "crash", "slow")),
    ("policy", ("policy", "account", "ban", "disable", "misuse", "trial")),
    ("cost", ("credit", "cost", "expensive", "limit")),
)
USE_CASES = {
    "code_generation": ("code",), "creative_writing": ("text",), "image_generation": ("image",), "video_generation": ("video",),
    "audio_generation": ("audio",), "chat_conversation": ("text", "multimodal"), "multimodal_tasks": ("multimodal",),
}
CONTEXT_DEFAULTS = (
    (("gpt-4-turbo", "gpt-4-1106"), 128000), (("gpt-4-32k",), 32768), (("gpt-4",), 8192), (("gpt-3.5-turbo-16k",), 16384), (("gpt-3.5",), 4096),
    (("claude-3",), 200000), (("claude-2",), 100000), (("glm", "z-ai"), 128000), (("deepseek",), 32768), (("mistral",), 32768),
)
GENERIC_MODELS = ("general", "unknown", "ai", "llm")


def any_of(words) -> str:
    """One pattern that finds any of the words as they stand."""
    return "|".join(re.escape(w).replace("\\ ", " ").replace('\\"', '"') for w in words)


def holds(column: Column, words) -> Column:
    """The text holds any of the words: one pass of one pattern."""
    return column.rlike(any_of(words)) if words else F.lit(False)


def first_rule(column: Column, rules, default) -> Column:
    """Value of the first (value, words) whose words the text holds."""
    out = F.lit(default)
    for value, words in reversed(tuple(rules)):
        out = F.when(holds(column, words), F.lit(value)).otherwise(out)
    return out


def variations(spark: SparkSession) -> DataFrame:
    """(ord, canonical, variation), in order of declaration; a fixed small table."""
    rows = [(c, v) for c, vs in VARIATIONS for v in vs]
    return spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(rows)], "ord int, canonical string, variation string")


def templates(spark: SparkSession) -> DataFrame:
    """(template_ord, pattern_type, pattern): the search query templates."""
    rows = [(k, p) for k, ps in QUERY_TEMPLATES for p in ps]
    return spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(rows)], "template_ord int, pattern_type string, pattern string")
