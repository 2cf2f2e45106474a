"""Running numbers and sums along the rows of groups, where one group may hold most of the rows.

Rows are dealt by ranges of (group, order) and numbered once; what a range holds of a group is summed, so a running sum is
the one within the range and that of the ranges before. No task holds more of a group than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """The rows, written to a shared folder and read again: lineage ends here."""
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sequenced(spark: SparkSession, rows: DataFrame, group: str, order: list[str], path: str) -> DataFrame:
    """The rows in order of (group, order), with ``_at``, which ascends, and ``_part``, the range."""
    by = [group, *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return written(spark, dealt, path).withColumn("_part", F.shiftright("_at", 33))


def running(rows: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """Adds for each column a running sum over the group's rows in order, this row's included: {column: name of the sum}."""
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(group, "_part").agg(*(F.sum(c).alias(c) for c in columns))
    before = held.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{s}") for c, s in columns.items()))
    within = Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select("*", *(F.sum(c).over(within).alias(s) for c, s in columns.items()))
    out = sums.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.select(*rows.columns, *((F.col(s) + F.col(f"_{s}")).alias(s) for s in columns.values()))


def reached(spark: SparkSession, heads: DataFrame, pointers: DataFrame, root: str) -> DataFrame:
    """(at): all that the pointers (at, to) lead to from the heads (at), these included.

    After round k the rows within 2^k steps are marked and pointers leap 2^k rows, so rounds are the logarithm of the longest way.
    """
    marked, leap, k = written(spark, heads.select("at").distinct(), f"{root}/marked0"), written(spark, pointers, f"{root}/leap0"), 0
    while not leap.isEmpty():
        k += 1
        found = marked.join(leap, "at").select(F.col("to").alias("at"))
        marked = written(spark, marked.unionByName(found).distinct(), f"{root}/marked{k}")
        onward = leap.select(F.col("at").alias("to"), F.col("to").alias("then"))
        leap = written(spark, leap.join(onward, "to").select("at", F.col("then").alias("to")), f"{root}/leap{k}")
    return marked

