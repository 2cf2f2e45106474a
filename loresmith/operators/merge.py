"""Merging extracted items: ordered dedup, folds by service, group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = ("problems", "tips", "cost_info", "settings")


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def dedup_ordered(items: DataFrame, keys: list[str], item: str, order: str, *, fold_case: bool = True) -> DataFrame:
    """The first spelling of each item of a group, by case-folded text without white space around it: (keys, item, order).

    A grouped minimum, not a window: partial on the map side, one small state an item.
    """
    key = F.lower(stripped(F.col(item))) if fold_case else F.col(item)
    out = items.groupBy(*keys, key.alias("_key")).agg(F.min_by(item, order).alias(item), F.min(order).alias(order))
    return out.drop("_key")


def ordered_list(df: DataFrame, keys: list[str], item: str, order: str, name: str) -> DataFrame:
    """One array of each group's items, in order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i")))), lambda x: x["i"]).alias(name))


def merge_by_service(items: DataFrame) -> DataFrame:
    """One row a service, whatever its case: first spelling and time, sums, and the four lists.

    items: (ord, service, list_name, item, batch_size, ts). Problems, tips and costs are distinct as
    spelled, in sorted order; settings keep their first order.
    """
    key = F.lower("service").alias("service_key")
    heads = items.groupBy(key).agg(F.min_by("service", "ord").alias("service"), F.min_by("ts", "ord").alias("ts"), F.sum("batch_size").alias("batch_size"))
    distinct = items.groupBy(key, "list_name", "item").agg(F.min("ord").alias("ord"))
    lists = distinct.groupBy("service_key").agg(
        *(F.array_sort(F.collect_list(F.when(F.col("list_name") == n, F.col("item")))).alias(n) for n in LISTS[:3]),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("list_name") == "settings") & F.col("item").isNotNull(), F.struct("ord", "item")))), lambda x: x["item"]).alias("settings"),
    )
    return heads.join(lists, "service_key")


def merge_ids(rows: DataFrame, text: str, order: str, id_col: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one case-folded text as one: its first spelling, and the sorted unions of its ids and of its ``lists``."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return rows.groupBy(F.lower(F.col(text)).alias("key")).agg(F.min_by(text, order).alias(text), F.array_sort(F.collect_set(id_col)).alias("ids"), *map(union, lists))


def dedup_md5(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each distinct text; ``order`` is unique.

    Only hashes are grouped: texts stay where they are, and the rows that come first are kept.
    """
    first = rows.groupBy(F.md5(F.col(text)).alias("_md5")).agg(F.min(order).alias("_first")).select("_first")
    return rows.join(first, F.col(order) == F.col("_first"), "left_semi")


def practice_groups(practices: DataFrame) -> DataFrame:
    """Tips, settings, problems and costs by model, from (ord, models, type, content, details, problem, solution, savings)."""
    from loresmith.functions import lookups, names

    p = practices.withColumn("model", F.explode("models")).where(~F.lower("model").isin(*lookups.GENERIC_MODELS))
    p = p.withColumn("model", names.sanitise_model(F.col("model"))).where("model is not null")
    same = F.lower("details") == F.lower("content")
    tip = F.when(F.coalesce(F.col("details"), F.lit("")).isin("") | same, F.col("content")).otherwise(F.concat(F.col("content"), F.lit(" - "), F.col("details")))
    setting = F.when(lookups.holds(F.lower("details"), ("parameter", "setting", "config", "=")), F.col("details"))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("ord", c.alias("x"))))), lambda s: s["x"])
    return p.groupBy("model").agg(
        pick(F.when(F.col("type") == "tip", tip)).alias("tips"), pick(setting).alias("settings"),
        pick(F.when(F.col("type") == "problem", F.concat_ws(" - ", "problem", "solution"))).alias("problems"), pick(F.col("savings")).alias("cost_info"),
    )


def chunk_results(rows: DataFrame) -> DataFrame:
    """Services named in chunk results: all practices in order; and the mean quality of results that have one.

    rows: (ord, name, practice, quality).
    """
    s = ordered_list(rows.where("practice is not null"), ["name"], "practice", "ord", "practices")
    every = rows.groupBy("name").agg(F.coalesce(F.avg("quality"), F.lit(0.5)).alias("quality"), F.count("practice").alias("n_practices"))
    return every.join(s, "name", "left")


def confidence(practices: DataFrame) -> DataFrame:
    """(entity, confidence): mean of each entity, and 'overall': one for ten practices, less for fewer."""
    by = practices.groupBy(F.coalesce("entity", F.lit("unknown")).alias("entity")).agg(F.avg(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    return by.unionByName(practices.agg(F.lit("overall").alias("entity"), F.least(F.lit(1.0), F.count(F.lit(1)) / 10).alias("confidence")))


def merge_chunk_services(rows: DataFrame) -> DataFrame:
    """Services that chunk results name, one row a name: the first one's type, and all practices in order.

    rows: (ord, chunk, name, type, practices array<string>); a bare mention has null type and
    practices. A name first seen as a bare mention has type unknown.
    """
    practices = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("practices", F.array().cast("array<string>")).alias("p")))), lambda x: x["p"]))
    return rows.groupBy(F.coalesce("name", F.lit("unknown")).alias("name")).agg(F.min_by(F.coalesce("type", F.lit("unknown")), "ord").alias("type"), practices.alias("practices"))


def entity_union(rows: DataFrame, key: str, lists: tuple[str, ...] = ("models", "services", "tools", "platforms")) -> DataFrame:
    """(key, entity): the distinct names of the four lists of a document's chunks; techniques are none."""
    return rows.select(key, F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(c, F.array().cast("array<string>")) for c in lists))))).alias("entity")).distinct()


#: What a post's practices are filed under (fixed values): category, list.
CATEGORIES = (("prompting", "prompt_patterns"), ("parameters", "parameter_recommendations"), ("pitfalls", "common_mistakes"), ("examples", "examples"), ("general_tips", "tips"))


def categorise(posts: DataFrame, key: str, order: str) -> DataFrame:
    """The five categories of each key's posts, items in the posts' order."""
    together = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(c, F.array().cast("array<string>")).alias("i")))), lambda x: x["i"]))
    return posts.groupBy(key).agg(*(together(c).alias(name) for name, c in CATEGORIES))


def extraction_confidence(services, practices):
    """Confidence of a processing step by its counts."""
    return F.when(services == 0, 0.0).when((services == 1) & (practices < 3), 0.3).when((services < 3) & (practices < 5), 0.5).when((services < 5) & (practices < 10), 0.7).otherwise(0.9)


def content_hash(merged: DataFrame) -> DataFrame:
    """md5 of the JSON object of each service's four sorted lists, keys in order, with a blank after commas and colons."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    listed = [F.concat(F.lit(f'"{n}": ['), F.array_join(F.transform(F.array_sort(F.col(n)), quoted), ", "), F.lit("]")) for n in sorted(LISTS)]
    return merged.select("service_key", F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *listed), F.lit("}"))).alias("content_hash"))
