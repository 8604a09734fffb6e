"""Quantiles from stored sketches: a span of days is merged, its rows are not read again.

A KLL sketch of size k answers any quantile with a rank error of about 2.3 / k**0.97 of the rows
(under 0.7 % for the size here) with high probability, whatever the number of rows, and sketches
of disjoint rows merge to one of the same size and error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 400


def sketched(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, sketch: what a run stores for its rows; null values are in neither."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SIZE).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of several runs or days as one for each of the ``keys`` left."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(share: float):
    return F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(share))
