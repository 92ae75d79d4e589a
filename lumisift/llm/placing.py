"""Places of rows in a total order within groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisift.llm.common import saved


def placed(rows: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their 0-based place within a group (no nulls), in order.

    Rows are dealt by range of (group, order), so a large group lies in many parts; each part is written sorted with a running
    number, and the sizes of groups within parts (a row each) say where a part's share of a group begins. Equal rows come in any order.
    """
    dealt = rows.repartitionByRange(F.col(group).asc(), *order).sortWithinPartitions(F.col(group).asc(), *order)
    written = saved(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    shares = written.groupBy(group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shares.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return written.join(offsets, [group, "__part"]).withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")
