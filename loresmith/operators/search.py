"""Search over entries: substring, edit distance, top-k, use cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresmith.functions import lookups, names
from loresmith.operators import strings

MATCH, SUGGEST = 0.3, 0.2


def entry_index(entries: DataFrame) -> DataFrame:
    """(ord, name, category): one row a distinct name, the first of it."""
    return entries.groupBy("name").agg(F.min("ord").alias("ord"), F.min_by("category", "ord").alias("category"))


def fuzzy_matches(queries: DataFrame, entries: DataFrame, *, threshold: float = MATCH) -> DataFrame:
    """(query, name, category, ord, similarity, match_type) of pairs at the threshold (over 0).

    A few questions go to every task, and the entries stream past them; a table of them meets the entries by shared
    grams (``strings.similar``). Distinct normal forms are compared, and names follow their forms.
    """
    e = entry_index(entries).withColumn("y", names.normalise(F.col("name")))
    q = queries.where("query is not null").select("query").distinct().withColumn("x", names.normalise(F.col("query")))
    if strings.few(queries, strings.FEW):
        x, y = F.col("x"), F.col("y")
        longest, part = F.greatest(F.length(x), F.length(y)), F.contains(x, y) | F.contains(y, x)
        met = e.join(F.broadcast(q), part | (F.abs(F.length(x) - F.length(y)) <= (1 - threshold) * longest + 1e-9))
        s = F.round(F.when(x == y, F.lit(1.0)).when(part, F.lit(0.8)).otherwise(1 - F.levenshtein(x, y) / longest), 6)
        pairs = met.withColumn("similarity", s).where(F.col("similarity") >= threshold)
    else:
        pairs = q.join(strings.similar(q.select("x"), e.select("y"), threshold), "x").join(e, "y")
    kind = F.when(F.col("similarity") == 1, "exact").when(F.col("similarity") >= 0.8, "close").otherwise("fuzzy")
    return pairs.select("query", "name", "category", "ord", "similarity", kind.alias("match_type"))


def top_matches(queries: DataFrame, entries: DataFrame, k: int = 5, threshold: float = MATCH) -> DataFrame:
    """The k best entries of each query; ties in entry order."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "ord"))
    return fuzzy_matches(queries, entries, threshold=threshold).withColumn("rank", rank).where(F.col("rank") <= k)


def best_match(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """One row a query: by exact spelling or a variation, then by normal form, then the nearest name.

    The later entry wins its own spelling; a variation never replaces one that is there.
    """
    e = entries.select("name", "category", "ord")
    own = e.groupBy(F.lower("name").alias("key")).agg(F.max_by("name", "ord").alias("exact"))
    form = e.groupBy(names.normalise(F.col("name")).alias("key")).agg(F.max_by("name", "ord").alias("same"))
    other = entry_index(entries).select("name", "ord", F.explode(names.variations(F.col("name"))).alias("key")).groupBy("key").agg(F.min_by("name", "ord").alias("varied"))
    q = queries.select("query").distinct()
    by = q.join(own, F.lower("query") == own["key"], "left").drop("key").join(other, F.lower("query") == other["key"], "left").drop("key")
    by = by.join(form, names.normalise(F.col("query")) == form["key"], "left").drop("key")
    near = top_matches(q, entries, 1).select("query", F.col("name").alias("near"), F.col("similarity").alias("near_similarity"), F.col("match_type").alias("near_type"))
    by = by.join(near, "query", "left")
    hit = F.coalesce("exact", "varied")
    return by.select(
        "query", F.coalesce(hit, "same", "near").alias("name"),
        F.when(hit.isNotNull(), 1.0).when(F.col("same").isNotNull(), 0.95).otherwise(F.col("near_similarity")).alias("similarity"),
        F.when(hit.isNotNull(), "exact").when(F.col("same").isNotNull(), "normalized").otherwise(F.col("near_type")).alias("match_type"),
    ).where("name is not null")


def suggestions(queries: DataFrame, entries: DataFrame, k: int = 3) -> DataFrame:
    """(query, name, confidence): whole per cents."""
    return top_matches(queries, entries, k, SUGGEST).select("query", "name", "rank", F.floor(F.col("similarity") * 100 + 0.5).cast("long").alias("confidence"))


def substring(entries: DataFrame, text: str, limit: int = 10) -> DataFrame:
    return entry_index(entries).where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("category", "name").limit(limit)


def site_search(entries: DataFrame, text: str = "", category: str | None = None) -> DataFrame:
    """Entries whose category, name, title, tags or summary hold the text; the category only counts without one."""
    hay = F.lower(F.concat_ws(" ", "category", "name", "title", F.array_join("tags", " "), "summary"))
    found = entries.where(F.contains(hay, F.lit(text.lower()))) if text else entries.where(F.col("category") == category) if category else entries
    return found.orderBy(F.lower(F.coalesce("title", "name")), "ord")


def recommend(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """(use_case, category, name): entries of each use case's categories."""
    pairs = spark.createDataFrame([(u, c) for u, cs in lookups.USE_CASES.items() for c in cs], "use_case string, category string")
    return entry_index(entries).join(F.broadcast(pairs), "category").select("use_case", "category", "name")


def context_lengths(models: DataFrame, known: DataFrame) -> DataFrame:
    """Adds context_length to (model): the known one, that of the first id that holds the name, or the pattern's default.

    known: (ord, model_id, context_length).
    """
    exact = known.groupBy("model_id").agg(F.max_by("context_length", "ord").alias("_x")).withColumnRenamed("model_id", "_id")
    distinct = models.select("model").distinct()
    if strings.few(known, strings.FEW_HELD):
        part = distinct.join(F.broadcast(known), F.contains("model_id", "model"))
    else:
        held = strings.holding(distinct.select(F.col("model").alias("needle")), known.select(F.col("model_id").alias("hay")))
        part = held.join(known, held["hay"] == known["model_id"]).withColumnRenamed("needle", "model")
    part = part.groupBy("model").agg(F.min_by("context_length", "ord").alias("_p"))
    one = distinct.join(exact, F.col("model") == F.col("_id"), "left").join(part, "model", "left")
    return models.join(one.select("model", F.coalesce("_x", "_p", names.context_length(F.col("model"))).cast("long").alias("context_length")), "model")
