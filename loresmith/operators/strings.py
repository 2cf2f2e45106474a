"""Joins of strings by likeness and by containment, through inverted indexes and equal keys.

Near strings: one edit changes at most q of a string's q-grams, so strings x and y of a similarity of at least t
(one less the edit distance by the longer length) share a number of q-grams that grows with the longer one. With grams in one order for all
strings, rarest first, such a pair shares one among the first few of each (prefix filter); pairs meet by that gram, are
kept where it is the first one that they share, and are verified by their distance. q falls with t, and single characters hold for
every t above 0.

Contained strings: a needle's rarest trigrams are looked up in the index of the hays' trigrams; hays in all of
these posting lists are verified. Needles shorter than three characters are grams themselves.

Both compare distinct strings, so repeated ones cost nothing; nulls meet nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Posting lists that a hay must be in.
PROBES = 2
#: Rows of a side up to which it goes to every task instead, and each string is compared with all of it: by distance, by containment.
FEW, FEW_HELD = 32, 256


def few(df: DataFrame, most: int) -> bool:
    """Whether a side has so few rows, by counting one row more at most."""
    return df.limit(most + 1).count() <= most


def gram_size(threshold: float) -> int:
    """The longest grams that a similarity still guarantees enough of."""
    return 1 if threshold < 0.65 else 2 if threshold < 0.8 else 3


def numbered_grams(c: Column, q: int) -> Column:
    """A string's q-grams, framed by q - 1 marks at either end, each with its number among its equals: 'a' twice gives a1 and a2."""
    framed = F.concat(F.lit("\x02" * (q - 1)), c, F.lit("\x03" * (q - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length(framed) - (q - 1)), lambda i: F.substring(framed, i, F.lit(q)))
    grams = F.when(F.length(c) > 0, grams).otherwise(F.array().cast("array<string>"))
    count = F.aggregate(
        F.array_sort(grams), F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"), F.lit(0).alias("n")),
        lambda acc, g: F.struct(
            F.concat(acc["out"], F.array(F.concat(g, F.when(acc["last"] == g, acc["n"] + 1).otherwise(F.lit(1)).cast("string")))).alias("out"), g.alias("last"), F.when(acc["last"] == g, acc["n"] + 1).otherwise(F.lit(1)).alias("n")
        ),
    )
    return count["out"]


def near(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(x, y, distance): pairs of a string x of ``left`` (x) and y of ``right`` (y), neither empty, of at least that similarity (over 0)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    q = gram_size(threshold)
    share = 1 - q * (1 - threshold)  # of the longer length: grams that a pair shares at least, less q - 1
    both = left.where("x <> ''").select("x").distinct().select("x", F.lit(0).alias("side")).unionByName(right.where("y <> ''").select(F.col("y").alias("x")).distinct().select("x", F.lit(1).alias("side")))
    grams = both.select("x", "side", F.explode(numbered_grams(F.col("x"), q)).alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    total = F.length("x") + (q - 1)
    need = F.greatest(F.ceil(F.length("x") * F.lit(share) + (q - 1) - 1e-6), F.lit(1))
    ranked = grams.join(often, "gram").groupBy("x", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda g: g["gram"]).alias("grams"))
    first = ranked.select("x", "side", F.slice("grams", F.lit(1), (total - need + 1).cast("int")).alias("grams"))
    spread = first.select("x", "side", "grams", F.explode("grams").alias("gram"))
    a = spread.where("side = 0").select("gram", "x", F.col("grams").alias("xs"))
    b = spread.where("side = 1").select("gram", F.col("x").alias("y"), F.col("grams").alias("ys"))
    lengths = (F.length("y") >= F.length("x") * F.lit(threshold) - 1e-9) & (F.length("x") >= F.length("y") * F.lit(threshold) - 1e-9)
    met = a.join(b, "gram").where(lengths & (F.element_at(F.array_intersect("xs", "ys"), 1) == F.col("gram")))
    longest = F.greatest(F.length("x"), F.length("y"))
    found = met.select("x", "y", F.levenshtein("x", "y").alias("distance"))
    return found.where(F.col("distance") <= (1 - threshold) * longest + 1e-9)


def _grams(c: Column, size: int) -> Column:
    """A string's distinct grams of a size; none where it is shorter."""
    places = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(c, i, F.lit(size))))


def holding(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay): every string of ``needles`` (needle) with every one of ``hays`` (hay) that holds it. An empty needle is in all."""
    n, h = needles.where("needle is not null").select("needle").distinct(), hays.where("hay is not null").select("hay").distinct()
    size = F.least(F.length("needle"), F.lit(3))
    own = n.where("needle <> ''").select("needle", F.explode(F.when(size == 3, _grams(F.col("needle"), 3)).otherwise(F.array("needle"))).alias("gram"))
    wanted = own.select("gram").distinct()
    every = F.flatten(F.array(*(_grams(F.col("hay"), k) for k in (1, 2, 3))))
    postings = h.select("hay", F.explode(every).alias("gram")).join(wanted, "gram", "left_semi")
    often = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    lists = own.join(often, "gram", "left").groupBy("needle").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("lists"))
    probes = lists.where(F.col("lists")[0]["n"] > 0).select("needle", F.slice("lists", 1, PROBES).alias("lists"))  # a gram of no hay: in none
    probes = probes.select("needle", F.size("lists").alias("k"), F.explode("lists").alias("list")).select("needle", "k", F.col("list.gram").alias("gram"))
    met = probes.join(postings, "gram").groupBy("needle", "hay").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k")).where("n = k")
    found = met.where(F.contains("hay", "needle")).select("needle", "hay")
    empty = n.where("needle = ''")  # distinct: one row at most
    return found.unionByName(h.join(F.broadcast(empty), F.substring("hay", 1, 0) == F.col("needle")).select("needle", "hay"))


def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(x, y, similarity) of normal forms at the threshold: 1 if equal, 0.8 if one holds the other, else one less the distance by the longer length.

    left: (x); right: (y). Nothing else meets an empty string but what holds it.
    """
    xs, ys = left.where("x is not null").select("x").distinct(), right.where("y is not null").select("y").distinct()
    held = holding(xs.withColumnRenamed("x", "needle"), ys.withColumnRenamed("y", "hay")).select(F.col("needle").alias("x"), F.col("hay").alias("y"))
    held = held.unionByName(holding(ys.withColumnRenamed("y", "needle"), xs.withColumnRenamed("x", "hay")).select(F.col("hay").alias("x"), F.col("needle").alias("y")))
    held = held.distinct().withColumn("similarity", F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.8)).where(F.col("similarity") >= threshold)
    close = near(xs, ys, threshold).where(~(F.contains("x", "y") | F.contains("y", "x")))
    return held.unionByName(close.select("x", "y", F.round(1 - F.col("distance") / F.greatest(F.length("x"), F.length("y")), 6).alias("similarity")))
