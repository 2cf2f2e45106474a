"""Rules over sources and corpora: one row a finding (entity, severity, rule, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITIES = ("ultra", "critical", "high", "medium", "low")
EXPECTED = ("prompting.md", "metadata.json")
KNOWN = ("prompting.md", "parameters.json", "pitfalls.md", "cost_optimization.md", "metadata.json")


def findings(df: DataFrame, entity: Column, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Rules (severity, rule, broken, message) in one pass of the rows."""
    each = [F.when(broken, F.struct(F.lit(sev).alias("severity"), F.lit(rule).alias("rule"), msg.alias("message"))) for sev, rule, broken, msg in rules]
    return df.select(entity.alias("entity"), F.explode(F.array_compact(F.array(*each))).alias("f")).select("entity", "f.*")


def source_findings(sources: DataFrame, order: str = "ord") -> DataFrame:
    """Required fields, URL form, priority, models, and URLs that stand a second time."""
    again = F.row_number().over(Window.partitionBy("url").orderBy(order)) > 1
    s = sources.where("url is not null").withColumn("_again", again)  # sources without a URL are not one group
    s = s.unionByName(sources.where("url is null").withColumn("_again", F.lit(False)))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return findings(s, F.col("name"), [
        ("error", "missing_name", blank("name"), F.lit("name is required")),
        ("error", "missing_url", blank("url"), F.lit("url is required")),
        ("error", "bad_url", ~blank("url") & ~F.col("url").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+"), F.concat(F.lit("not a URL: "), F.col("url"))),
        ("error", "duplicate_url", F.col("_again"), F.concat(F.lit("duplicate URL: "), F.col("url"))),
        ("error", "bad_priority", ~F.coalesce(F.col("priority").isin(*PRIORITIES), F.lit(False)), F.concat(F.lit("priority: "), F.coalesce("priority", F.lit("none")))),
        ("warning", "no_models", F.coalesce(F.size("models"), F.lit(0)) <= 0, F.lit("no models")),
    ])


def corpus_findings(tree: DataFrame, as_of: str) -> DataFrame:
    """Missing, empty, unparsable, short, outdated and unexpected files of entries (category, slug, file, content)."""
    entity = F.concat_ws("/", "category", "slug")
    entries = tree.select("category", "slug").distinct()
    wanted = entries.withColumn("file", F.explode(F.array(*map(F.lit, EXPECTED))))
    missing = wanted.join(tree, ["category", "slug", "file"], "left_anti").select(entity.alias("entity"), F.lit("error").alias("severity"), F.lit("missing_file").alias("rule"), F.col("file").alias("message"))
    blank, js, md = F.trim("content") == "", F.col("file").endswith(".json"), F.col("file").endswith(".md")
    seen = F.try_to_timestamp(F.get_json_object("content", "$.last_updated"))
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(seen)) / F.lit(86_400_000_000))
    checked = findings(tree, entity, [
        ("error", "empty_file", blank, F.col("file")),
        ("error", "bad_json", ~blank & js & F.try_parse_json("content").isNull(), F.col("file")),
        ("warning", "short_file", ~blank & md & (F.length("content") < 100), F.col("file")),
        ("error", "missing_field", (F.col("file") == "metadata.json") & ~blank & F.get_json_object("content", "$.data_sources").isNull(), F.lit("data_sources")),
        ("warning", "outdated", (F.col("file") == "metadata.json") & (age > 180), F.col("file")),
        ("warning", "unexpected_file", ~F.col("file").isin(*KNOWN), F.col("file")),
    ])
    return reduce(DataFrame.unionByName, [missing, checked])
