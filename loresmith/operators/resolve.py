"""Alias resolution: spellings to canonical names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresmith.functions import lookups, names
from loresmith.operators import strings


def alias_map(static: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(alias, canonical): of the spellings declared, and then of the registry's, the later one wins.

    static: (ord, canonical, variation); registry: (ord, key, display_name).
    """
    def spelled(df: DataFrame, text: Column, base: int) -> DataFrame:
        both = F.array(F.struct(F.lower(text).alias("alias"), F.lit(0).alias("k")), F.struct(names.normalise(text).alias("alias"), F.lit(1).alias("k")))
        return df.select("canonical", (F.col("ord").cast("long") * 4 + base).alias("at"), F.explode(both).alias("a")).select("canonical", (F.col("at") + F.col("a.k")).alias("at"), "a.alias")

    rows = spelled(static, F.col("variation"), 0)
    if registry is not None:
        known = static.select("canonical", names.normalise(F.col("variation")).alias("form"), F.col("ord").alias("vord")).groupBy("form").agg(F.min_by("canonical", "vord").alias("matched"))
        r = registry.withColumn("form", names.normalise(F.col("display_name"))).join(F.broadcast(known), "form", "left")
        r = r.withColumns({"canonical": F.coalesce("matched", "key"), "at": F.col("ord").cast("long") * 4 + (1 << 40)})
        pairs = F.array(F.struct(F.col("key").alias("alias"), F.lit(0).alias("k")), F.struct(F.lower("display_name").alias("alias"), F.lit(1).alias("k")),
                        F.struct(F.when(F.col("matched").isNull(), F.col("form")).alias("alias"), F.lit(2).alias("k")))
        rows = rows.unionByName(r.select("canonical", "at", F.explode(pairs).alias("a")).where("a.alias is not null").select("canonical", (F.col("at") + F.col("a.k")).alias("at"), "a.alias"))
    return rows.groupBy("alias").agg(F.max_by("canonical", "at").alias("canonical"))


def resolve(df: DataFrame, name: str, static: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds canonical: by the lower-case name, else its normal form, else the first spelling that holds it or that it holds.

    Each distinct name is resolved once; a few spellings go to every task,
    and more meet the names through an index of grams.
    """
    aliases = alias_map(static) if aliases is None else aliases
    distinct = df.select(F.col(name).alias("_n")).distinct()
    low, form = F.lower("_n"), names.normalise(F.col("_n"))
    by = lambda k: aliases.select(F.col("alias").alias(f"_a{k}"), F.col("canonical").alias(f"_c{k}"))
    found = distinct.join(by(1), low == F.col("_a1"), "left").join(by(2), form == F.col("_a2"), "left")
    rest = found.where("_c1 is null and _c2 is null").select("_n", low.alias("_low"))
    spelled = static.select(F.lower("variation").alias("_v"), "canonical", "ord")
    if strings.few(static, strings.FEW_HELD):
        part = rest.join(F.broadcast(spelled), F.contains("_low", "_v") | F.contains("_v", "_low"))
    else:
        held = strings.holding(rest.select(F.col("_low").alias("needle")), spelled.select(F.col("_v").alias("hay"))).select(F.col("needle").alias("_low"), F.col("hay").alias("_v"))
        holds = strings.holding(spelled.select(F.col("_v").alias("needle")), rest.select(F.col("_low").alias("hay"))).select(F.col("hay").alias("_low"), F.col("needle").alias("_v"))
        part = rest.join(held.unionByName(holds), "_low").join(spelled, "_v")
    part = part.groupBy("_n").agg(F.min_by("canonical", "ord").alias("_c3"))
    one = found.join(part, "_n", "left").select("_n", F.coalesce("_c1", "_c2", "_c3").alias("canonical"))
    return df.join(one, df[name].eqNullSafe(one["_n"]), "left").drop("_n")


def mentions(docs: DataFrame, text: str, aliases: list[tuple[str, str]]) -> DataFrame:
    """(docs' columns, canonical): each canonical name that the text mentions, by plain substring, once a row.

    One scan of each text per spelling in the projection; no join and no shuffle.
    """
    by: dict[str, list[str]] = {}
    for canonical, spelling in aliases:
        by.setdefault(canonical, []).append(spelling)
    low = F.lower(F.col(text))
    hits = F.array(*(F.when(lookups.holds(low, tuple(s.lower() for s in ss)), F.lit(c)) for c, ss in by.items()))
    return docs.withColumn("canonical", F.explode(F.array_compact(hits)))


#: Characters of the spellings that go to every task as one automaton.
AUTOMATON = 32_000_000


def mentions_of(docs: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """(docs' columns, canonical): ``mentions`` for a table of spellings (canonical, spelling), by one pass over each text.

    Up to ``AUTOMATON`` characters of distinct spellings go to every task, which builds one automaton of them and runs each
    text through it once, whatever their number. Beyond that texts and spellings meet through the index of grams.
    Null texts and spellings mention nothing; an empty spelling stands in every text.
    """
    low = aliases.where("canonical is not null and spelling is not null").select(F.col("canonical").cast("string").alias("canonical"), F.lower("spelling").alias("spelling")).distinct()
    size = low.agg(F.sum(F.length("spelling") + F.length("canonical") + 1)).first()[0] or 0
    if size > AUTOMATON:
        t = docs.select(F.lower(F.col(text)).alias("_low"))
        met = strings.holding(low.select(F.col("spelling").alias("needle")), t.select(F.col("_low").alias("hay")))
        found = met.join(low, met["needle"] == low["spelling"]).select(F.col("hay").alias("_low"), "canonical").distinct()
        return docs.withColumn("_low", F.lower(F.col(text))).join(found, "_low").drop("_low")
    spark = docs.sparkSession
    names_, by = [], {}
    for canonical, spelling in sorted(map(tuple, low.collect())):
        if not names_ or names_[-1] != canonical:
            names_.append(canonical)
        by.setdefault(spelling, []).append(len(names_) - 1)
    sent = spark.sparkContext.broadcast((names_, by))

    @F.pandas_udf("array<string>")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        known, places = sent.value
        machine, always = ahocorasick.Automaton(), places.get("", [])
        for spelling, which in places.items():
            if spelling:
                machine.add_word(spelling, which)
        machine.make_automaton()

        def of(t: str | None) -> list[str]:
            if t is None:
                return []
            found = set(always)
            if len(machine):
                for _, which in machine.iter(t):
                    found.update(which)
            return [known[i] for i in sorted(found)]

        for some in texts:
            yield some.map(of)

    return docs.withColumn("canonical", F.explode(hits(F.lower(F.col(text)))))


def match_services(queries: DataFrame, services: DataFrame, static: DataFrame) -> DataFrame:
    """(query, canonical, service_name, category): the first registry row of each query's canonical name.

    A query whose name resolves but has no row gets category general; one that does not has nulls.
    """
    reg = resolve(services, "name", static).where("canonical is not null")
    first = reg.groupBy("canonical").agg(F.min_by("name", "ord").alias("service_name"), F.min_by("category", "ord").alias("found"))
    q = resolve(queries, "query", static)
    return q.join(first, "canonical", "left").select("query", "canonical", "service_name", F.when(F.col("canonical").isNotNull(), F.coalesce("found", F.lit("general"))).alias("category"))


def display_names(keys: DataFrame, services: DataFrame, static: DataFrame) -> DataFrame:
    """Adds display_name to (canonical): the first registry row's, else the first spelling, else the key."""
    reg = resolve(services, "name", static).groupBy("canonical").agg(F.min_by("name", "ord").alias("_r"))
    spelled = static.groupBy("canonical").agg(F.min_by("variation", "ord").alias("_s"))
    return keys.join(reg, "canonical", "left").join(F.broadcast(spelled), "canonical", "left").select(*keys.columns, F.coalesce("_r", "_s", "canonical").alias("display_name"))


def all_variations(static: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(canonical, variations): every spelling of a name.

    registry: (ord, key, display_name). A display name that is a declared spelling in normal form
    joins that name's; any other row is a name of its own, by key, display name and its lower case; of rows
    with one key the last counts.
    """
    rows = static.select("canonical", F.col("variation").alias("v"))
    if registry is not None:
        form = static.select("canonical", names.normalise(F.col("variation")).alias("form"), "ord").groupBy("form").agg(F.min_by("canonical", "ord").alias("matched"))
        r = registry.withColumn("form", names.normalise(F.col("display_name"))).join(form, "form", "left")
        own = r.where("matched is null").groupBy("key").agg(F.max_by("display_name", "ord").alias("n"))
        rows = rows.unionByName(r.where("matched is not null").select(F.col("matched").alias("canonical"), F.col("display_name").alias("v")))
        rows = rows.unionByName(own.select(F.col("key").alias("canonical"), F.explode(F.array("key", "n", F.lower("n"))).alias("v")))
    return rows.groupBy("canonical").agg(F.array_sort(F.collect_set("v")).alias("variations"))


def variations_of(queries: DataFrame, static: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(query, variations): all spellings of what each query means, the query itself where that is unknown."""
    known = resolve(queries.select("query").distinct(), "query", static, alias_map(static, registry))
    return known.join(all_variations(static, registry), "canonical", "left").select("query", F.coalesce("variations", F.array("query")).alias("variations"))


def first_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
