"""Ranks and running sums inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.workspace import materialise


def ranked(rows: DataFrame, group: str, order: list[str], weight: Column, name: str) -> DataFrame:
    """Adds ``name``: the summed weight of the rows before each in its group.

    Rows are dealt into ranges of (group, order), summed within them, and the ranges'
    sums are added, so that no group is one task's work.  Rows of equal order share a range.
    """
    dealt = rows.repartitionByRange(group, *order).withColumns({"range": F.spark_partition_id(), "weight": weight})
    dealt = materialise(dealt, "ranges")
    sums = dealt.groupBy(group, "range").agg(F.sum("weight").alias("n"))
    before = sums.select(F.col(group).alias("of"), F.col("range").alias("at"), (F.sum("n").over(Window.partitionBy(group).orderBy("range")) - F.col("n")).alias("before"))
    within = F.sum("weight").over(Window.partitionBy(group, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")
    found = dealt.withColumn("within", within).join(before, F.expr(f"{group} <=> of AND range = at"))
    return found.withColumn(name, F.col("before") + F.col("within")).drop("of", "at", "before", "within", "range", "weight")
