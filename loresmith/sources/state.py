"""State files: sources of a configuration, model contexts, extraction results, the update log, run reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.sources import shared


def by_priority(sources: DataFrame, priority: str = "high") -> DataFrame:
    return sources.where(F.col("priority") == priority)


def for_model(sources: DataFrame, model: str) -> DataFrame:
    """Forum sources of a model or of all models, and every code host source."""
    return sources.where(((F.col("source_type") == "reddit") & (F.array_contains("models", model) | F.array_contains("models", "general"))) | (F.col("source_type") == "github"))


def default_sources(sources: DataFrame, limit: int = 5) -> list[str]:
    """Names to scan of the first high-priority sources; two forums where none fits."""
    path = F.regexp_replace(F.regexp_extract("url", r"github\.com/(.*)", 1), "/+$", "")
    name = F.when(F.col("source_type") == "reddit", F.concat(F.lit("reddit:"), F.element_at(F.split("name", "/"), -1))).when((F.col("source_type") == "github") & (path != ""), F.concat(F.lit("github:"), path))
    order = [c for c in ("path", "ord") if c in sources.columns]
    rows = by_priority(sources).orderBy(*order).limit(limit).select(name.alias("n")).where("n is not null").collect()
    return [r["n"] for r in rows] or ["reddit:LocalLLaMA", "reddit:OpenAI"]


def model_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(ord, model_id, context_length, max_completion_tokens, name, pricing) of a landed context file."""
    schema = "models map<string, struct<context_length:int, max_completion_tokens:int, name:string, pricing:map<string,string>>>"
    m = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode(F.map_entries("models")).alias("ord", "e"))
    return m.select("ord", F.col("e.key").alias("model_id"), F.coalesce("e.value.context_length", F.lit(4096)).alias("context_length"), "e.value.max_completion_tokens", "e.value.name", "e.value.pricing")


def fetch_contexts(spark: SparkSession, get: Callable[[], dict]) -> DataFrame:
    """The same of a catalogue's answer, {"data": [{"id", "context_length", ...}]}; without an answer no rows.

    get: asks the catalogue; the network is the caller's.
    """
    try:
        found = get().get("data", [])
    except Exception:
        found = []
    rows = {m.get("id", ""): (m.get("context_length", 4096), m.get("max_completion_tokens"), m.get("name", m.get("id", "")), {k: str(v) for k, v in (m.get("pricing") or {}).items()}) for m in found}
    return spark.createDataFrame([(i, k, *v) for i, (k, v) in enumerate(rows.items())], "ord int, model_id string, context_length int, max_completion_tokens int, name string, pricing map<string,string>")


#: A page of a catalogue's answer.
_PAGE = "data array<struct<id:string, context_length:int, max_completion_tokens:int, name:string, pricing:map<string,string>>>"


def catalogue_contexts(pages: DataFrame) -> DataFrame:
    """The contexts of landed pages of a catalogue's answers (page, content); ord is (page, place).

    An id that comes again keeps its first place and takes the later values. A page that is no such JSON lists nothing.
    """
    m = pages.select("page", F.posexplode(F.from_json("content", _PAGE)["data"]).alias("pos", "m"))
    at = F.struct("page", "pos")
    m = m.withColumn("_id", F.coalesce("m.id", F.lit(""))).groupBy("_id").agg(F.min(at).alias("ord"), F.max_by("m", at).alias("m"))
    length = F.coalesce("m.context_length", F.lit(4096)).alias("context_length")
    return m.select("ord", F.col("_id").alias("model_id"), length, "m.max_completion_tokens", F.coalesce("m.name", "_id").alias("name"), "m.pricing")


def context_stats(contexts: DataFrame, large: int = 100_000) -> DataFrame:
    """One row (models, large, free) of the contexts; free: the prompt's price is the text "0"."""
    free = F.count_if(F.coalesce(F.element_at("pricing", "prompt") == "0", F.lit(False)))
    return contexts.agg(F.count(F.lit(1)).alias("models"), F.count_if(F.col("context_length") > large).alias("large"), free.alias("free"))


def largest_contexts(contexts: DataFrame, n: int = 5, large: int = 100_000) -> DataFrame:
    """The n largest of the large contexts (a top-k), ties by id."""
    return contexts.where(F.col("context_length") > large).orderBy(F.desc("context_length"), "model_id").limit(n)


def save_contexts(contexts: DataFrame, path: str, now: str) -> None:
    """A context file that ``model_contexts`` reads: models by id, and when they were fetched. A catalogue is small."""
    rows = contexts.orderBy("ord").collect()
    models = {r["model_id"]: {"context_length": r["context_length"], "max_completion_tokens": r["max_completion_tokens"], "name": r["name"], "pricing": r["pricing"]} for r in rows}
    shared.write_text(contexts.sparkSession, path, json.dumps({"models": models, "fetched_at": now}, indent=2))


def hub_services(spark: SparkSession) -> DataFrame:
    """Services of the model hub, which lists none: an empty table of the discovered shape."""
    return spark.createDataFrame([], "name string, url string, description string, category string, source string")


def source_of(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(query, and the columns of sources): the first source of each name, "r/" before either of them aside.

    sources: (ord, name, ...); names: (query).
    """
    bare = lambda c: F.lower(F.regexp_replace(c, "^r/", ""))
    keyed = sources.withColumn("_k", bare(F.col("name")))
    first = keyed.groupBy("_k").agg(F.min_by(F.struct(*sources.columns), "ord").alias("_s"))
    return names.withColumn("_k", bare(F.col("query"))).join(first, "_k", "left").select("query", "_s.*")


def cleanup(spark: SparkSession, patterns: list[str], *, dry_run: bool = True) -> list[str]:
    """Paths that the glob patterns match, deleted unless it is a dry run."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in patterns:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        for s in fs.globStatus(at) or []:
            out.append(s.getPath().toString())
            if not dry_run:
                fs.delete(s.getPath(), True)
    return sorted(out)


def extraction_results(spark: SparkSession, path: str) -> DataFrame:
    """One row an item of the results of run files: (ord, service, list_name, item, batch_size, ts)."""
    r = spark.read.schema("results array<struct<service:string,problems:array<string>,tips:array<string>,cost_info:array<string>,settings:array<string>,setttings:array<string>,batch_size:bigint,timestamp:string>>").json(path, multiLine=True)
    r = r.select(F.posexplode("results").alias("ord", "r")).select("ord", "r.*").where("service is not null")
    lists = F.array(*(F.struct(F.lit(n).alias("list_name"), F.col(n).alias("items")) for n in ("problems", "tips", "cost_info", "settings")), F.struct(F.lit("settings").alias("list_name"), F.col("setttings").alias("items")))
    one = r.select("ord", "service", "batch_size", F.col("timestamp").alias("ts"), F.posexplode(lists).alias("k", "l")).select("*", F.posexplode_outer("l.items").alias("i", "item"))
    at = F.col("ord").cast("long") * (1 << 32) + F.col("k") * (1 << 24) + F.coalesce("i", F.lit(0))
    return one.select(at.alias("ord"), "service", "l.list_name", "item", F.when((F.col("k") == 0) & (F.coalesce("i", F.lit(0)) == 0), F.coalesce("batch_size", F.lit(0))).otherwise(0).alias("batch_size"), "ts")


def update_log(spark: SparkSession, path: str) -> DataFrame:
    """(service_key, ts, total, content_hash) of a log file; a missing one is empty."""
    schema = "services map<string, struct<timestamp:string, content_counts:struct<tips:int,problems:int,cost_info:int,settings:int>, content_hash:string>>"
    try:
        raw = spark.read.schema(schema).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], schema)
    c = "e.value.content_counts."
    total = sum((F.coalesce(F.col(c + n), F.lit(0)) for n in ("problems", "cost_info", "settings")), F.coalesce(F.col(c + "tips"), F.lit(0)))
    return raw.select(F.explode(F.map_entries("services")).alias("e")).select(F.col("e.key").alias("service_key"), F.try_to_timestamp(F.col("e.value.timestamp")).alias("ts"), total.cast("long").alias("total"), "e.value.content_hash")


def run_report(results: DataFrame, now: str) -> DataFrame:
    """One row of counters and results, to be written as JSON: queries run, successful, failed, posts, results."""
    r = F.struct(*results.columns)
    return results.agg(
        F.lit(now).alias("timestamp"), F.count(F.lit(1)).alias("queries_run"), F.count_if(F.col("error").isNull()).alias("successful_queries"),
        F.count_if(F.col("error").isNotNull()).alias("failed_queries"), F.sum("batch_size").alias("total_posts_scraped"), F.collect_list(r).alias("results"),
    )


def registry_json(registry: DataFrame, now: str) -> DataFrame:
    """A registry as one JSON document's row: services by canonical name, aliases, last_updated."""
    services = registry.select(
        "canonical_name", F.struct("canonical_name", "display_name", "aliases", "category", "description", "url", "sources", F.lit(now).alias("first_seen"), F.lit(now).alias("last_seen")).alias("s"), F.explode("aliases").alias("alias")
    )
    return services.agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("canonical_name", "s")))).alias("services"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("alias", "canonical_name")))).alias("aliases"), F.lit(now).alias("last_updated")
    )


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.json") -> str | None:
    """The newest file of a folder by modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.agg(F.max_by("path", "modificationTime").alias("p")).first()
    return row["p"]


def repo_readme(files: DataFrame, owner: str = "dair-ai") -> DataFrame:
    """README texts (repo, content) cut to their first 3,000 characters; a bare name belongs to the default owner."""
    repo = F.when(F.contains("repo", F.lit("/")), F.col("repo")).otherwise(F.concat(F.lit(owner + "/"), "repo"))
    return files.select(repo.alias("repo"), F.substring("content", 1, 3000).alias("content"))


def dispatch(names: list[str]) -> tuple[list[str], list[str]]:
    """(forums, repositories) of source names; other kinds are ignored."""
    return [n[7:] for n in names if n.startswith("reddit:")], [n[7:] for n in names if n.startswith("github:")]


def commit_message(changed: DataFrame, day: str) -> str:
    """Message for an update of services: three names in the title at most, ten in the body."""
    distinct = changed.select(F.col("entity").alias("k")).distinct()
    total, names = distinct.count(), [r["k"] for r in distinct.orderBy("k").limit(10).collect()]
    if not names:
        return "docs: Update service documentation"
    title = f"docs: Update {', '.join(names)} documentation" if total <= 3 else f"docs: Update {total} service documentations"
    body = ["", "Updated services:", *(f"- {n}" for n in names), *([f"- ... and {total - 10} more"] if total > 10 else []), "", f"Extraction date: {day}"]
    return title + "\n".join(["", *body])
