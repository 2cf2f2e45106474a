"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so it is distributed, partially aggregated on
the map side, and open to adaptive skew splitting; edges are written to the shared folder after
each round. Links, nodes and components never reach the driver: two numbers a round do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresmith.llm.store import Stash


def components(stash: Stash, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that a link joins to another; root is the smallest node reachable.

    Null ends and self-links are ignored, repeated links count once. No links: no rows.
    """
    edges = stash.put(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stash.put(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = stash.put(small.where("u != v").distinct(), "small")
        stash.drop(edges, large)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
