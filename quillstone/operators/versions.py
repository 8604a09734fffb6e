"""Versions of documents: lineage, alignment, referential actions, word diff."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s+|\S+")


def numbered(versions: DataFrame, doc: str, *order: str) -> DataFrame:
    return versions.withColumn("version_number", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def lineage(versions: DataFrame, doc: str) -> DataFrame:
    """Versions with is_current (the last) and the number before."""
    w = Window.partitionBy(doc)
    before = F.lag("version_number").over(w.orderBy("version_number"))
    return versions.withColumns({"is_current": F.col("version_number") == F.max("version_number").over(w), "previous": before})


def aligned(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer alignment by topic.  diff: missing on either side, same or changed."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    diff = F.when(F.col("in_left").isNull() | F.col("in_right").isNull(), "missing").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").withColumn("diff", diff).drop("in_left", "in_right")


def cascade_delete(child: DataFrame, fk: str, gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not among the deleted."""
    return child.join(gone.select(F.col(key).alias("__gone")), F.col(fk) == F.col("__gone"), "left_anti")


def set_null(child: DataFrame, fk: str, gone: DataFrame, key: str) -> DataFrame:
    """All children; the reference to a deleted parent becomes null."""
    marked = child.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(fk) == F.col("__gone"), "left")
    return marked.withColumn(fk, F.when(F.col("__gone").isNull(), F.col(fk))).drop("__gone")


def matched(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each side belong to the longest common subsequence.

    Row by row from the end, one bit is kept for each pair of places: whether passing the
    left token keeps at least as much in common as passing the right one.  So memory is
    an eighth of a byte a pair, and of equal choices a deletion comes first.
    """
    known: dict[str, int] = {}
    x, y = (np.array([known.setdefault(t, len(known)) for t in s], dtype=np.int64) for s in (a, b))
    kept = np.zeros(len(x), bool), np.zeros(len(y), bool)
    below, bits = np.zeros(len(y) + 1, np.int32), [b""] * len(x)
    for i in range(len(x) - 1, -1, -1):
        row = below.copy()
        row[:-1] = np.maximum(row[:-1], np.where(y == x[i], below[1:] + 1, 0))
        # A row falls from left to right, so its maxima from the right complete it.
        row = np.maximum.accumulate(row[::-1])[::-1]
        bits[i] = np.packbits(below[:-1] >= row[1:]).tobytes()
        below = row
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            kept[0][i] = kept[1][j] = True
            i, j = i + 1, j + 1
        elif bits[i][j >> 3] >> (7 - (j & 7)) & 1:
            i += 1
        else:
            j += 1
    return kept


def word_diff(before: str, after: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(text, kind) segments of both sides; kinds same, del, add.  White-space runs are
    tokens, so each side's segments give it back."""
    tokens = TOKEN.findall(before or ""), TOKEN.findall(after or "")

    def segments(own: list[str], kept: np.ndarray, kind: str) -> list[tuple[str, str]]:
        edges = [0, *(np.flatnonzero(np.diff(kept)) + 1).tolist(), len(own)]
        return [("".join(own[at:end]), "same" if kept[at] else kind) for at, end in pairwise(edges) if at < end]

    left, right = matched(*tokens)
    return segments(tokens[0], left, "del"), segments(tokens[1], right, "add")


SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.string())]))


def diff_table(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """``keys`` with the word diff of two text columns (left, right), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pairs_of(batch)
            found = [word_diff(x, y) for x, y in rows]
            sides = [pa.array([[{"text": t, "kind": k} for t, k in f[side]] for f in found], SEGMENT) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *sides], [*keys, "left", "right"])

    def pairs_of(batch: pa.RecordBatch) -> list[tuple]:
        return list(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True))

    segment = "array<struct<text:string,kind:string>>"
    schema = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, before, after).mapInArrow(run, f"{schema}, left {segment}, right {segment}")
