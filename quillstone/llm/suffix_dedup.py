"""Removal of long strings that recur anywhere in the collection, byte for byte.

A window is a ``LENGTH``-byte string of one document.  Windows are never compared all
with all; four steps find those that occur twice:

1. ``anchors``: among the ``GRAM``-byte grams of a window the one with the least hash (the
   leftmost of equals) is its anchor.  That choice depends on the window's bytes alone,
   so equal windows have equal anchors at equal distances.  Neighbouring windows mostly
   share an anchor; such a run of windows with its bytes is a *context*.
2. ``shared_contexts``: contexts whose anchor's hash occurs once hold no repeated
   window.  The others get their bytes back from the text.
3. Equal contexts (a 256-bit digest of bytes and place of the anchor) are counted by
   partial aggregation: of thousands of copies one context goes on, with its count.
4. ``column_order``: the contexts of one anchor are documents of a small collection,
   aligned at the anchor, and its suffixes are sorted column by column from right to
   left.  Each round inserts one symbol per document: the documents' order by suffix
   (their column of the collection's Burrows-Wheeler transform) follows from the order
   before by one stable sort on the inserted symbols, and the common prefixes of
   neighbours by range minima of those before, plus one.  A suffix that agrees in
   ``LENGTH`` symbols with a neighbour starts a repeated window.

Only suffixes of one column are merged, as equal windows always share one; a plain
construction over whole texts would need a round for each byte of the longest text.  A
collection is bounded: an anchor with more than ``HEAVY`` distinct contexts, such as one
in a common line in ever new surroundings, is no collection.  Its windows are told apart
by 256-bit digests and counted by partial aggregation, so it is many tasks' work.  Both
ways find the same windows.

Defined results.  Null text counts as empty; texts under ``LENGTH`` bytes lose nothing.
Strings are judged on the input.  Repeated rows, also of one identifier, are documents
of their own, so all of them lose all that a window covers.  Texts of any length are read
whole, in overlapping pieces of 1 MiB.  An empty table gives an empty result.  Only the
identifier and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quillstone.llm.exact_dedup import BLOOM
from quillstone.llm.rows import as_batch, map_rows
from quillstone.sources.workspace import materialise, settings

LENGTH = 200
GRAM = 32
#: Windows looked at together in a very long text; also the range of packed positions.
PIECE = 1 << 20
#: Bytes of contexts sorted together, about.
COLLECTION_BYTES = 16_000_000
#: Distinct contexts up to which those of one anchor are a collection.
HEAVY = 4096
#: Parts that an anchor's contexts are dealt into while shared ones are found.
SALTS = 32

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
CONTEXT = pa.schema([("key", pa.int64()), ("check", pa.int32()), ("anchor", pa.int64()), ("start", pa.int64()), ("before", pa.int32()), ("windows", pa.int32())])
BYTES = pa.schema([*CONTEXT, ("content", pa.binary()), ("bytes", pa.binary())])
WINDOW = pa.schema([("anchor", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("at", pa.int32()), ("window", pa.binary())])
REPEATS = pa.schema([("anchor", pa.int64()), ("content", pa.binary()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    n = PIECE + LENGTH + 1
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(BASE))]))
        down = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(inverse))]))
    return up, down


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte gram, from prefix sums of a polynomial."""
    up, down = powers()
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> U(32)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def contexts(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, first window, bytes of the context before the anchor, windows."""
    h = gram_hashes(data)
    span = length - GRAM + 1
    # Hash above, position below: the least is the least hash, leftmost of equals.
    low, reach = (h & ~U(PIECE * 2 - 1)) | np.arange(len(h), dtype=U), 1
    while reach * 2 <= span:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = (low & U(PIECE * 2 - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    windows = np.diff(first, append=len(at))
    return h[at[first]].view(np.int64), first, at[first] - first, windows


def anchors(docs: DataFrame) -> DataFrame:
    """Contexts, without their bytes, of every document (key, check, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for key, check, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for base in range(0, len(data) - LENGTH + 1, PIECE):
                    found, first, before, windows = contexts(data[base : base + PIECE + LENGTH - 1])
                    parts.append((np.full(len(found), key), np.full(len(found), check), found, first + base, before, windows))
                    size += len(found)
                if size > 50_000:
                    yield joined(parts)
                    parts, size = [], 0
            if parts:
                yield joined(parts)

    def joined(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*parts, strict=True), CONTEXT, strict=True)], schema=CONTEXT)

    return docs.select("key", "check", "text").mapInArrow(run, from_arrow_schema(CONTEXT))


def shared_contexts(docs: DataFrame) -> DataFrame:
    """Contexts, with bytes and digest, whose anchor occurs twice or more."""
    every = materialise(anchors(docs), "contexts", compression="zstd")
    # Only membership is asked, so a common anchor is counted and joined in SALTS parts.
    salted = every.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)))
    parts = salted.groupBy("anchor", "salt").agg(F.count("*").alias("n")).groupBy("anchor").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    twice = parts.filter("n > 1").select("anchor", F.explode("salts").alias("salt"))
    # A set, as repeated rows have the same key and the same contexts.
    own = salted.join(twice, ["anchor", "salt"]).groupBy("key", "check").agg(F.collect_set(F.struct("anchor", "start", "before", "windows")).alias("own"))
    own = materialise(own, "shared", compression="zstd").filter("key >= -9223372036854775808").withColumnsRenamed({"key": "of", "check": "of_check"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            keys, checks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, check, text, own in zip(keys, checks, batch.column(2), batch.column(3), strict=True):
                data = memoryview(text.as_buffer())
                for c in own.as_py():
                    part = bytes(data[c["start"] : c["start"] + c["windows"] + LENGTH - 1])
                    digest = sha256(b"%d " % c["before"] + part).digest()
                    rows.append((key, check, c["anchor"], c["start"], c["before"], c["windows"], digest, part))
                    size += len(part)
                    if size > 4_000_000:
                        yield as_batch(rows, BYTES)
                        rows, size = [], 0
            if rows:
                yield as_batch(rows, BYTES)

    with settings(docs.sparkSession, BLOOM):
        found = docs.join(own, F.expr("key = of AND check = of_check")).select("key", "check", "text", "own").mapInArrow(run, from_arrow_schema(BYTES))
        return materialise(found, "shared-contexts", compression="zstd")


def column_order(group: np.ndarray, before: np.ndarray, parts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """For each column, from right to left, the documents with a suffix there that agrees
    in ``length`` symbols with another's of its group.

    ``group``: the documents' groups; ``before``: symbols left of the anchor, column 0.
    """
    n = len(parts)
    size = np.array([len(p) for p in parts])
    left, right = int(before.max()), int((size - before).max())
    columns = left + right
    # The symbols, column by column; 0 where a document has none.
    table = np.zeros((columns, n), np.uint16)
    for i, p in enumerate(parts):
        table[left - before[i] : left - before[i] + size[i], i] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, np.int64)  # common[i]: of the i-th and the one before it
    for column in range(columns - 1, -1, -1):
        symbol = table[column]
        key = group[order] * 300 + symbol[order]
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        follows = np.zeros(n, bool)
        follows[1:] = (key[1:] == key[:-1]) & (symbol[order[turn[1:]]] > 0)
        at = np.flatnonzero(follows)
        new = np.zeros(n + 1, np.int64)
        if len(at):
            ends = np.empty(2 * len(at), np.int64)
            ends[0::2], ends[1::2] = turn[at - 1] + 1, turn[at] + 1
            new[at] = np.minimum.reduceat(common, ends)[0::2] + 1
        order, common = order[turn], new
        long = common >= length
        hit = long[:-1] | long[1:]
        if hit.any():
            yield column - left, order[hit]


def repeated_windows(rows: pa.Table) -> pa.Table:
    """Runs of repeated windows (first and last, from the context's start) of each distinct context."""
    names = ("anchor", "content", "before", "windows", "n", "bytes")
    found, content, before, windows, copies, parts = (rows.column(c).to_pylist() for c in names)
    n = len(parts)
    group = np.unique(np.array(found, np.int64), return_inverse=True)[1].astype(np.int64)
    before, windows = np.array(before), np.array(windows)
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    starts: list[list[int]] = [[] for _ in range(n)]
    if len(several):
        for column, docs in column_order(group[several], before[several], [parts[i] for i in several]):
            for i in several[docs]:
                starts[i].append(column + int(before[i]))
    rows = []
    for i in range(n):
        own = range(int(windows[i])) if copies[i] > 1 else starts[i][::-1]
        if len(own):
            rows.append((found[i], content[i], *runs_of(own)))
    return pa.Table.from_batches([as_batch(rows, REPEATS)] if rows else [], schema=REPEATS)


def runs_of(starts: Sequence[int]) -> tuple[list[int], list[int]]:
    """First and last of each run of successive numbers, in order."""
    x = np.asarray(starts, np.int64)
    cut = np.flatnonzero(np.diff(x) > 1)
    return x[np.concatenate([[0], cut + 1])].tolist(), x[np.concatenate([cut, [len(x) - 1]])].tolist()


def heavy_windows(contexts: DataFrame) -> DataFrame:
    """Runs of repeated windows of contexts whose anchor has too many for a collection."""

    def windows(anchor, content, n, windows, data) -> Iterator[tuple]:
        for at in range(windows):
            yield anchor, content, n, at, sha256(data[at : at + LENGTH]).digest()

    def runs(anchor, content, at) -> Iterator[tuple]:
        yield anchor, content, *runs_of(sorted(at))

    each = materialise(map_rows(contexts, ["anchor", "content", "n", "windows", "bytes"], windows, WINDOW), "heavy-windows", compression="zstd")
    twice = each.groupBy("anchor", "window").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "window")
    found = each.join(twice, ["anchor", "window"]).groupBy("anchor", "content").agg(F.collect_set("at").alias("at"))
    return map_rows(found, ["anchor", "content", "at"], runs, REPEATS)


def repeats(shared: DataFrame) -> DataFrame:
    """key, check, start, end: covered bytes of each document, in pieces that may overlap."""
    heavy = shared.select("anchor", "content").distinct().groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("anchor")
    heavy = materialise(heavy, "heavy-anchors")
    distinct = shared.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes"), F.first("before").alias("before"), F.first("windows").alias("windows"))
    # Anchors are dealt into collections by their hash.
    total = shared.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    collections = max(1, -(-total // COLLECTION_BYTES))
    dealt = distinct.join(heavy, "anchor", "left_anti").withColumn("collection", F.pmod("anchor", F.lit(collections)))
    runs = dealt.groupBy("collection").applyInArrow(repeated_windows, from_arrow_schema(REPEATS))
    runs = materialise(runs.union(heavy_windows(distinct.join(heavy, "anchor"))), "repeats", compression="zstd")
    back = shared.select("key", "check", "anchor", "content", "start").join(runs, ["anchor", "content"])
    pieces = back.select("key", "check", "start", F.explode(F.arrays_zip("first", "last")).alias("run"))
    return pieces.select("key", "check", (F.col("start") + F.col("run.first")).alias("start"), (F.col("start") + F.col("run.last") + LENGTH).alias("end"))


def cut_row(doc_id, text, pieces) -> Iterator[tuple]:
    """Merge the covered pieces and cut them out."""
    data = text.encode("utf-8", "surrogatepass")
    spans: list[list[int]] = []
    for p in sorted(pieces or [], key=lambda p: p["start"]):
        if spans and p["start"] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], p["end"])
        else:
            spans.append([p["start"], p["end"]])
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    yield doc_id, len(data), [{"start": a, "end": b} for a, b in spans], b"".join(kept)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key and check (96 bits of two hashes).  Rows equal in both are the
    same row, repeated."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"key": F.xxhash64("doc_id", "text"), "check": F.hash("text", "doc_id")})


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans array<struct<start,end>>, kept (bytes)."""
    rows = keyed(docs, id_col, text_col)
    covered = repeats(shared_contexts(rows))
    # A set again, so that each of many repeated rows gets its pieces once.
    pieces = covered.groupBy("key", "check").agg(F.collect_set(F.struct("start", "end")).alias("pieces")).withColumnsRenamed({"key": "of", "check": "of_check"})
    return map_rows(rows.join(pieces, F.expr("key = of AND check = of_check"), "left"), ["doc_id", "text", "pieces"], cut_row, KEPT, batch_rows=256)
