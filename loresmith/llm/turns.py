"""Rows of groups in order, with their places, where one group may hold most of all rows.

Rows are dealt by ranges of (group, order), so that a large group spreads over many tasks; a row's place
is its running number less that of its group's first row, corrected by what earlier ranges hold of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loresmith.llm.store import Stash


def sequenced(stash: Stash, rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` written in order of (group, order), with ``_at``: numbers that ascend in this order."""
    by = [group, *order]
    return stash.put(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)


def part() -> F.Column:
    """The range a row is in: the upper bits of its number."""
    return F.shiftright("_at", 33)


def runs(rows: DataFrame, group: str) -> DataFrame:
    """(group, _part, _shift, _n) of what each range holds of each group: a row's place is ``_at + _shift``; _n: rows of the whole group.

    At most one row for each group and range; two groups a range at most are in other ranges too.
    """
    held = rows.groupBy(group, part().alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("_n"))
