"""Extraction from packed posts: a pluggable extractor for each partition, offline ones, and reply parsing."""

from __future__ import annotations

import hashlib
import json
import queue
import re
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEMA = "service string, batch int, problems array<string>, tips array<string>, cost_info array<string>, settings array<string>, batch_size int, error string"
LISTS = ("problems", "tips", "cost_info", "settings")
#: Batches or replies that a task holds as Python objects; Arrow hands them over by thousands.
AT_ONCE = 64


class Extractor(Protocol):
    """Reply to a prompt; made once a task."""

    def __call__(self, prompt: str) -> str: ...


def prompt_of(service: str, posts: list[dict]) -> str:
    """What an extractor is asked: posts about a service, the four lists wanted, as JSON."""
    body = json.dumps([{"id": p["post_id"], "title": p.get("title") or "", "content": p.get("content") or ""} for p in posts], ensure_ascii=False)
    return f"Service: {service}\nList only what the posts say about it: problems, tips, cost_info, settings (as key=value).\nPosts: {body}\nAnswer with one JSON object."


class RuleExtractor:
    """Sentences by pattern: prices and limits, key=value settings, faults, and advice. No model, no network."""

    RULES = (
        ("cost_info", re.compile(r"\$\s?\d|\b(?:price|credits?|per month|free tier|limit)\b", re.I)),
        ("settings", re.compile(r"\b[A-Za-z_][\w.]*\s*=\s*\S+")),
        ("problems", re.compile(r"\b(?:error|bug|crash\w*|fails?|broken|not working)\b", re.I)),
        ("tips", re.compile(r"\b(?:use|set|try|avoid|enable|disable|should)\b", re.I)),
    )

    def __call__(self, prompt: str) -> str:
        posts = json.loads(re.search(r"^Posts: (.*)$", prompt, re.M)[1])
        out: dict[str, list[str]] = {k: [] for k in LISTS}
        for p in posts:
            for sentence in re.split(r"(?<=[.!?])\s+|\n+", f"{p['title']}\n{p['content']}"):
                for name, rule in self.RULES:
                    if rule.search(sentence):
                        out[name].append(sentence.strip())
                        break
        return json.dumps({"service": prompt.split("\n", 1)[0].removeprefix("Service: "), **out}, ensure_ascii=False)


class RecordedExtractor:
    """Replies recorded by the md5 of their prompt."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def __call__(self, prompt: str) -> str:
        return self.replies[hashlib.md5(prompt.encode()).hexdigest()]


class Retrying:
    """Another extractor, asked again after 2, 4, ... seconds, 60 at most; a refusal of the key is raised at once.

    last: what is said when all tries fail; None raises the last try's error, as replies that are kept need.
    """

    def __init__(self, inner: Extractor, tries: int = 3, sleep: Callable[[float], None] = time.sleep, last: str | None = "{}"):
        self.inner, self.tries, self.sleep, self.last = inner, tries, sleep, last

    def __call__(self, prompt: str) -> str:
        for k in range(self.tries):
            try:
                return self.inner(prompt)
            except PermissionError:
                raise
            except Exception:
                if k + 1 < self.tries:
                    self.sleep(min(60, 2 ** (k + 1)))
                elif self.last is None:
                    raise
        return self.last or "{}"


class Limited:
    """Another extractor, with so many seconds for a reply; ``TimeoutError`` beyond them.

    A call that is given up goes on in its thread until it ends by itself, and what it says is lost.
    """

    def __init__(self, inner: Extractor, seconds: float = 120):
        self.inner, self.seconds = inner, seconds

    def __call__(self, prompt: str) -> str:
        said: queue.SimpleQueue = queue.SimpleQueue()

        def call() -> None:
            try:
                said.put((self.inner(prompt), None))
            except BaseException as e:
                said.put((None, e))

        threading.Thread(target=call, daemon=True).start()
        try:
            reply, error = said.get(timeout=self.seconds)
        except queue.Empty:
            raise TimeoutError(f"no reply in {self.seconds} seconds") from None
        if error is not None:
            raise error
        return reply


class Paced:
    """Another extractor, a call of which begins so many seconds after the last one's end at the earliest. Each task keeps its own pace."""

    def __init__(self, inner: Extractor, seconds: float = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.seconds, self.clock, self.sleep = inner, seconds, clock, sleep
        self._end: float | None = None

    def __call__(self, prompt: str) -> str:
        if self._end is not None and (left := self._end + self.seconds - self.clock()) > 0:
            self.sleep(left)
        try:
            return self.inner(prompt)
        finally:
            self._end = self.clock()


@dataclass(frozen=True)
class Provider:
    """How a provider is asked: what makes its extractor, the seconds for one reply, and those between two calls of a task."""

    make: Callable[[], Extractor]
    limit: float = 120
    pause: float = 0


def provided(name: str, providers: Mapping[str, Provider], *, limit: float | None = None, tries: int = 3, last: str | None = "{}") -> Callable[[], Extractor]:
    """Makes the named provider's extractor in each task, with its limit (or ``limit``), its pace and retries around it.

    ``extract`` and ``extract_resumable`` take the result; the latter with ``last=None``, so that a failure is asked again and not kept.
    """
    if name not in providers:
        raise ValueError(f"no provider {name!r}; there are {', '.join(sorted(providers))}")
    p = providers[name]

    def make() -> Extractor:
        inner: Extractor = Limited(p.make(), p.limit if limit is None else limit)
        return Retrying(Paced(inner, p.pause) if p.pause else inner, tries, last=last)

    return make


def reply_json(reply: str) -> dict | None:
    """The JSON object of a reply: whole, fenced, or between the outermost braces."""
    for t in (reply, *(m[1] for m in re.finditer(r"```(?:json)?\s*(\{.*?\})\s*```", reply, re.S)), *(m[0] for m in re.finditer(r"\{.*\}", reply, re.S))):
        try:
            v = json.loads(t)
        except ValueError:
            continue
        if isinstance(v, dict):
            return v
    return None


def as_items(value) -> list[str]:
    """A list of strings, whatever was sent: dicts become 'key = value'."""
    if isinstance(value, dict):
        return [f"{k} = {v}" for k, v in value.items()]
    out: list[str] = []
    for v in value if isinstance(value, list) else []:
        out += [f"{k} = {x}" for k, x in v.items()] if isinstance(v, dict) else [str(v)]
    return out


def ask(extractor: Extractor, service: str, posts: list[dict], limit: int | None, tries: int = 3) -> dict:
    """Lists of one batch; a batch whose prompt is over the limit is halved and merged in order."""
    prompt = prompt_of(service, posts)
    if limit is not None and len(prompt) // 4 > limit and len(posts) > 1:
        half = len(posts) // 2
        a, b = ask(extractor, service, posts[:half], limit, tries), ask(extractor, service, posts[half:], limit, tries)
        out = {k: list({x.lower().strip(): x for x in reversed(a[k] + b[k])}.values())[::-1] for k in LISTS}
        return out | {"error": a["error"] or b["error"]}
    for _ in range(tries):
        v = reply_json(extractor(prompt))
        if v is not None:
            v["settings"] = as_items(v.get("settings") or v.get("setttings") or [])
            return {k: as_items(v.get(k)) for k in LISTS} | {"error": None}
    return {k: [] for k in LISTS} | {"error": "no JSON in the reply"}


def extract(batches: DataFrame, make: Callable[[], Extractor], *, limit: int | None = None) -> DataFrame:
    """One row a batch. batches: (service, batch, posts array<struct<post_id, title, content>>).

    Write the result before using it twice: a second run would ask again.
    """

    some = pa.list_(pa.string())
    kinds = pa.schema([("service", pa.string()), ("batch", pa.int32()), *((k, some) for k in LISTS), ("batch_size", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = make()
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                rows = [{"service": r["service"], "batch": r["batch"], "batch_size": len(r["posts"])} | ask(extractor, r["service"], r["posts"], limit) for r in b.slice(at, AT_ONCE).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return batches.select("service", F.col("batch").cast("int"), "posts").mapInArrow(run, SCHEMA)


class Unanswered(RuntimeError):
    """Prompts whose asking failed; what was answered is kept."""


REPLIES = "prompt_md5 string, reply string, error string"


def _kept(spark: SparkSession, path: str) -> DataFrame:
    """The replies kept so far; none where nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], REPLIES)
    return spark.read.schema(REPLIES).parquet(path)


def ask_missing(prompts: DataFrame, make: Callable[[], Extractor], path: str, *, rounds: int = 8, tries: int = 3) -> int:
    """Ask what is not in the table of replies yet, and keep the answers; how many prompts were asked.

    prompts: (prompt). A distinct prompt is asked once, whoever repeats it; its MD5 is its key. They are asked in rounds by their keys, and each
    round's answers are committed before the next, so a run that dies asks again what its last round asked at most. A
    prompt whose asking fails is left out, the others of its round are kept, and ``Unanswered`` is raised at the end.
    """
    spark, asked, failed = prompts.sparkSession, 0, 0
    keyed = prompts.where("prompt is not null").select("prompt").distinct().withColumn("prompt_md5", F.md5(F.col("prompt").cast("binary")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make()
        for f in (g.iloc[at : at + AT_ONCE] for g in frames for at in range(0, len(g), AT_ONCE)):
            rows = []
            for key, prompt in zip(f["prompt_md5"], f["prompt"], strict=True):
                try:
                    said = next((r for r in (extractor(prompt) for _ in range(tries)) if reply_json(r) is not None), None)
                    rows.append((key, said, None if said is not None else "no JSON in the reply"))
                except Exception as e:
                    rows.append((key, None, f"failed: {e}"))
            yield pd.DataFrame(rows, columns=["prompt_md5", "reply", "error"])

    for k in range(rounds):
        own = keyed.where(F.pmod(F.xxhash64("prompt_md5"), F.lit(rounds)) == k).join(_kept(spark, path).select("prompt_md5"), "prompt_md5", "left_anti")
        found = own.select("prompt_md5", "prompt").mapInPandas(run, REPLIES)
        done = f"{path}-round-{k}"
        found.write.mode("overwrite").parquet(done)  # asked once: what follows reads the answers
        answers = spark.read.schema(REPLIES).parquet(done)
        bad = F.coalesce(F.col("error").startswith("failed: "), F.lit(False))
        counts = answers.agg(F.count(F.lit(1)), F.count_if(bad)).first()
        asked, failed = asked + counts[0], failed + counts[1]
        answers.where(~bad).write.mode("append").parquet(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(done)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if failed:
        raise Unanswered(f"{failed} of {asked} prompts; run again to ask them")
    return asked


def prompt_column(service: str, posts: str) -> Column:
    """``prompt_of`` each batch."""

    @F.arrow_udf(StringType())
    def prompts(services: pa.Array, batches: pa.Array) -> pa.Array:
        cut = ((services.slice(at, AT_ONCE).to_pylist(), batches.slice(at, AT_ONCE).to_pylist()) for at in range(0, len(services), AT_ONCE))
        return pa.array((prompt_of(s, ps) for names, posts in cut for s, ps in zip(names, posts, strict=True)), pa.string())

    return prompts(service, posts)


def extract_resumable(batches: DataFrame, make: Callable[[], Extractor], path: str, *, rounds: int = 8) -> DataFrame:
    """``extract`` with the replies kept at ``path``: a run after a failed one asks only what is missing, and the result may be read as often as wanted."""
    prompted = batches.withColumn("prompt", prompt_column("service", "posts"))
    ask_missing(prompted, make, path, rounds=rounds)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (g.iloc[at : at + AT_ONCE] for g in frames for at in range(0, len(g), AT_ONCE)):
            rows = []
            for service, batch, size, reply, error in zip(f["service"], f["batch"], f["batch_size"], f["reply"], f["error"], strict=True):
                v = (reply_json(reply) if reply else None) or {}
                lists = {k: as_items(v.get(k)) for k in LISTS} | {"settings": as_items(v.get("settings") or v.get("setttings") or [])}
                rows.append({"service": service, "batch": batch, "batch_size": size, "error": error} | lists)
            yield pd.DataFrame(rows, columns=["service", "batch", *LISTS, "batch_size", "error"])

    replies = _kept(batches.sparkSession, path).groupBy("prompt_md5").agg(F.first("reply").alias("reply"), F.first("error").alias("error"))
    found = prompted.withColumn("prompt_md5", F.md5(F.col("prompt").cast("binary"))).join(replies, "prompt_md5")
    return found.select("service", F.col("batch").cast("int"), F.size("posts").alias("batch_size"), "reply", "error").mapInPandas(parse, SCHEMA)
