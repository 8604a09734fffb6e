"""Retrieval metrics over arrays: ``retrieved`` in rank order, ``relevant`` as a set; k >= 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hits(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    n = F.size(F.array_distinct(relevant))
    return F.when(n == 0, 0.0).otherwise(_hits(retrieved, relevant, k) / F.greatest(n, F.lit(1)))


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Over k, not over the list's length: short lists lose."""
    return _hits(retrieved, relevant, k) / F.lit(k)


def hit_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.when(_hits(retrieved, relevant, k) > 0, 1.0).otherwise(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """Of the first hit in the whole list."""
    ranks = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(ranks) > 0, 1.0 / F.try_element_at(ranks, F.lit(1))).otherwise(0.0)


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Binary gains; repeated ids count again, so the value can exceed 1."""
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    best = F.transform(F.slice(F.array_distinct(relevant), 1, k), lambda x, i: 1.0 / F.log2(i + 2.0))
    dcg, ideal = (F.aggregate(a, F.lit(0.0), lambda s, x: s + x) for a in (gains, best))
    return F.when(ideal > 0, dcg / F.when(ideal > 0, ideal).otherwise(1.0)).otherwise(0.0)


def mean(values: Column) -> Column:
    return F.coalesce(F.avg(values), F.lit(0.0))
