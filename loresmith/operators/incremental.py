"""What is stale, what changed, and the update log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresmith.functions import text


def latest(log: DataFrame, key: str = "service_key", ts: str = "ts") -> DataFrame:
    """The log's newest row of each key; of rows of one time the one whose other columns are greatest, left to right."""
    rest = [c for c in log.columns if c not in (key, ts)]
    last = log.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("_last"))
    return last.select(key, *(F.col(f"_last.`{c}`").alias(c) for c in (ts, *rest)))


def update_status(log: DataFrame, as_of: str) -> DataFrame:
    """(service_key, days, status): recent under 7 days, stale over 30, else current."""
    days = text.age_days(F.max("ts"), as_of)
    s = log.groupBy("service_key").agg(days.alias("days"))
    return s.withColumn("status", F.when(F.col("days") < 7, "recent").when(F.col("days") > 30, "stale").otherwise("current"))


def should_update(new: DataFrame, log: DataFrame, as_of: str, *, days: int = 7, growth: float = 1.3) -> DataFrame:
    """(service_key, total, should_update): unseen, older than ``days``, or grown by over 30 per cent.

    new, log: (service_key, ts, total).
    """
    seen = latest(log.select("service_key", "ts", "total")).select("service_key", F.col("ts").alias("_ts"), F.col("total").alias("_old"))
    due = F.col("_ts").isNull() | (text.age_days(F.col("_ts"), as_of) > days) | (F.col("total") > growth * F.col("_old"))
    return new.join(seen, "service_key", "left").select("service_key", "total", due.alias("should_update"))


def should_scrape(sources: DataFrame, state: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """(source, should_scrape): unseen, or seen over so many hours ago."""
    gap = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    last = state.groupBy("source").agg(F.max("ts").alias("last"))
    return sources.select("source").distinct().join(last, "source", "left").select("source", F.coalesce(gap > F.lit(hours * 3_600_000_000), F.lit(True)).alias("should_scrape"))


def cadence(log: DataFrame) -> DataFrame:
    """(service_key, n_updates, days_per_update): the span of updates by their number."""
    span = text.age_days_between(F.min("ts"), F.max("ts"))
    return log.groupBy("service_key").agg(F.count(F.lit(1)).alias("n_updates"), F.round(span / F.count(F.lit(1)), 6).alias("days_per_update"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones whose key has none."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots: (key, change)."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(True).alias("_was")), after.select(key, F.col(value).alias("_b"), F.lit(True).alias("_is"))
    j = a.join(b, key, "full_outer")
    kind = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(key, kind.alias("change")).where("change is not null")
