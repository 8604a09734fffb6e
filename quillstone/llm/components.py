"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.workspace import materialise


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours are linked to the least one around a node instead.

    ``large`` moves the larger neighbours of each node, otherwise the smaller ones.
    Only a minimum per node is gathered, never a neighbour list.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    moved = moved.filter(F.col("u") != F.col("v"))
    return moved if large else moved.distinct()


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has a parent."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node) for every node of ``edges`` (u, v).

    Every round is written to the shared folder, so lineage does not grow; the rounds
    number about the logarithm of the longest chain.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        now = materialise(star(star(now, large=True), large=False), "edges", replaces=now)
        if is_forest_of_stars(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
