"""The service registry: fold of discovered rows by canonical name, and its search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loresmith.functions import lookups, names
from loresmith.operators import ordered
from loresmith.sources import shared


def fold(services: DataFrame) -> DataFrame:
    """One row a canonical name: what the first row says, the longest description, all sources and aliases.

    services: (ord, name, category, description, url, source). Only small states meet in a group:
    a few ends by order, and the distinct sources and aliases.
    """
    s = services.withColumn("canonical_name", names.canonical(F.col("name")))
    return s.groupBy("canonical_name").agg(
        F.min_by("name", "ord").alias("display_name"), F.min_by("category", "ord").alias("category"), F.min_by("url", "ord").alias("url"),
        F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.array_union(F.collect_set(F.lower("name")), F.array(F.first("canonical_name")))).alias("aliases"),
        F.min("ord").alias("ord"),
    )


def fold_in_order(services: DataFrame) -> DataFrame:
    """(low, canonical_name): the fold where a name may be an earlier row's canonical name, so that aliases feed back in order.

    A spelling is its own canonical name if an earlier spelling, whose canonical name is not itself fed back, has it as
    its stripped form; else its canonical name is its stripped form. Spellings point at those that strip to them; whoever
    nobody points at is decided at once, and each round decides those all of whose pointers are, or one of whose pointers is not fed back. A
    pointer is shorter by a word stripped, so rounds are the words that can be stripped in turn. Spellings are distinct with their first order;
    null names are none.
    """
    spark, root = services.sparkSession, shared.folder(services.sparkSession, "registry")
    spell = services.where("name is not null").groupBy(F.lower("name").alias("low")).agg(F.min("ord").alias("ord")).withColumn("c", names.canonical(F.col("low")))
    spell = ordered.written(spark, spell, f"{root}/spellings")
    pointers = spell.select(F.col("low").alias("by"), F.col("ord").alias("before"), F.col("c").alias("low")).join(spell.select("low", "ord"), "low").where("before < ord and by <> low").select("low", "by")
    pointers = ordered.written(spark, pointers, f"{root}/pointers")
    # fed: the spelling has a pointer that is not fed back; open: it has pointers, none of them decided so
    fed = ordered.written(spark, spell.select("low").limit(0), f"{root}/fed0")
    free = ordered.written(spark, spell.select("low").join(pointers, "low", "left_anti"), f"{root}/free0")  # not fed back
    open_, k = ordered.written(spark, pointers.select("low").distinct(), f"{root}/open0"), 0
    while not open_.isEmpty():
        k += 1
        waiting = pointers.join(open_, "low", "left_semi")
        now = waiting.join(free.select(F.col("low").alias("by")), "by", "left_semi").select("low").distinct()
        undecided = waiting.join(fed.select(F.col("low").alias("by")), "by", "left_anti").select("low").distinct()  # a pointer that may yet be free
        fed = ordered.written(spark, fed.unionByName(now), f"{root}/fed{k}")
        free = ordered.written(spark, free.unionByName(open_.join(undecided, "low", "left_anti")), f"{root}/free{k}")
        open_ = ordered.written(spark, undecided.join(now, "low", "left_anti"), f"{root}/open{k}")
    own = spell.join(fed.withColumn("_fed", F.lit(True)), "low", "left")
    return own.select("low", F.when(F.col("_fed"), F.col("low")).otherwise(F.col("c")).alias("canonical_name"))


def tiers(services: DataFrame, priority: tuple[str, ...] = lookups.PRIORITY_NAMES) -> DataFrame:
    """Adds priority and tier. Where no service has a tier, all are medium; else those without are normal."""
    tier = F.when(lookups.holds(F.lower("name"), priority), 0).when(F.col("category").isin("video", "audio"), 1).when(F.col("category") == "image", 2)
    s = services.withColumn("_t", tier)
    has = F.max(F.when(F.col("_t").isNotNull(), 1).otherwise(0))
    any_tier = s.agg(has.alias("_any"))  # one row
    s = s.crossJoin(F.broadcast(any_tier))
    label = F.when(F.col("_t") == 0, "ultra").when(F.col("_t") == 1, "critical").when(F.col("_t") == 2, "high").when(F.col("_any") == 1, "normal").otherwise("medium")
    return s.select(*services.columns, label.alias("priority"), F.coalesce("_t", F.lit(3)).alias("tier"))


def plan_queries(services: DataFrame, patterns: DataFrame, *, max_queries: int = 100, use_all: bool = False, priority=lookups.PRIORITY_NAMES) -> DataFrame:
    """Search queries of the first services by tier, as many services as max_queries has room for.

    The services are cut by a top-k before templates multiply them.
    """
    if not use_all:
        patterns = patterns.withColumn("_rn", F.row_number().over(Window.partitionBy("pattern_type").orderBy("template_ord"))).where("_rn = 1").drop("_rn")
    top = tiers(services, priority).orderBy("tier", "ord").limit(max(1, max_queries // (20 if use_all else 5)))
    query = names.search_query(F.col("name"), F.col("pattern"))
    q = top.crossJoin(F.broadcast(patterns)).withColumn("query", query).withColumn("query_url", names.search_url(F.col("query")))
    q = q.orderBy("tier", "ord", "template_ord").limit(max_queries)
    return q.select(F.col("name").alias("service"), names.canonical(F.col("name")).alias("service_key"), "category", "query", "query_url", "pattern_type", "priority", "tier", "ord", "template_ord")


def query_summary(queries: DataFrame) -> DataFrame:
    """Counts by priority, category and pattern, each with the services it has, in one pass."""
    queries.createOrReplaceTempView("_queries_of_a_plan")
    return queries.sparkSession.sql(
        "SELECT priority, category, pattern_type, count(*) AS n, count(DISTINCT service) AS n_services FROM _queries_of_a_plan GROUP BY GROUPING SETS ((priority), (category), (pattern_type))"
    )


def coverage(queries: DataFrame, limit: int) -> DataFrame:
    """What a run with ``limit`` queries a service covers: (service, n_queries, n_run, n_left), and the sums in a row whose service is null.

    Queries of a null service belong to none and are not counted.
    """
    one = queries.where("service is not null").groupBy("service").agg(F.count(F.lit(1)).alias("n_queries"))
    run = F.least("n_queries", F.lit(limit))
    one = one.withColumns({"n_run": run, "n_left": F.col("n_queries") - run})
    return one.rollup("service").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_queries", "n_run", "n_left")))
