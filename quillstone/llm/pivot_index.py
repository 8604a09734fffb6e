"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest pivots in order (its permutation's start).  Inverted
lists hold the vectors of each pivot; vectors that share enough pivots meet there and their
cosine is verified in double precision.  Pivots are a sample of the rows, at most
``MAX_PIVOTS``, thinned so that no two are close: a dense group then has one pivot, and its
members the same neighbours around it.  Every row is indexed.

The work on a list stays bounded per task: a list is dealt into blocks, and blocks meet in
cells.  Two vectors that are both within half of the threshold's angle of one pivot are
linked by the triangle inequality: such a ball of vectors is counted, never paired, however
many rows it holds.  Equal vectors are one entry with a weight.

Results for odd input: a vector that is null, empty, zero or has null or non-finite parts
links with nothing and is a component of its own; vectors link with their own length only;
rows that repeat, identifier included, are vectors of their own, linked with each other; a
null identifier is never a component's name, unless the component has no other; an empty
table gives an empty result; only the two named columns are read, so no other can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import components
from quillstone.sources.workspace import materialise

#: Rows a pivot, about; a session's pivots are between LEAST and MAX_PIVOTS of the rows.
ROWS_A_PIVOT, LEAST_PIVOTS, MAX_PIVOTS = 32, 256, 16_384
#: Pivots closer than this (cosine) are one.
APART = 0.5
#: Nearest pivots kept of each vector, and how many of them two vectors must share.
NEAREST, SHARED = 8, 3
#: Vectors of a block; a cell compares two blocks.
BLOCK = 1024
#: Numbers of a task's larger arrays, at most: cosines with pivots, marks of shared pivots.
HELD = 1 << 21

DESCRIBED = "key long, vec array<double>, copies long, pivots array<int>, ball int"
FOUND = "key long, links long, least long"


def unit(vectors: list) -> np.ndarray:
    """Rows of unit length; scaled first, so that squares neither overflow nor vanish."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def entries(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """key, vec, copies, least_id: the distinct usable vectors, each with a number of its own."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("vec", lambda x: x != 0))
    found = rows.groupBy("vec").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"))
    return materialise(found.withColumn("key", F.monotonically_increasing_id()), "vectors")


def choose_pivots(found: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of each vector length: a bounded sample by hash, thinned in its order."""
    rows = found.count()
    want = min(MAX_PIVOTS, max(LEAST_PIVOTS, rows // ROWS_A_PIVOT))
    sample = found.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(want).collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row["vec"]), []).append(row["vec"])
    return {n: thinned(unit(rows)) for n, rows in by_length.items()}


def thinned(pivots: np.ndarray) -> np.ndarray:
    """The pivots that no earlier kept one is close to."""
    kept, n = np.empty_like(pivots), 0
    for p in pivots:
        if not n or (kept[:n] @ p).max() < APART:
            kept[n] = p
            n += 1
    return kept[:n]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The NEAREST pivots of each row in order, and the cosine of the first.

    Rows go in slices, so that memory does not grow with batch times pivots.
    """
    n = min(NEAREST, len(pivots))
    order, best = np.empty((len(x), n), np.int64), np.empty(len(x))
    step = max(1, HELD // len(pivots))
    for at in range(0, len(x), step):
        s = x[at : at + step] @ pivots.T
        near = np.sort(np.argpartition(s, len(pivots) - n, axis=1)[:, len(pivots) - n :], axis=1)
        turn = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        order[at : at + step] = np.take_along_axis(near, turn, 1)
        best[at : at + step] = s.max(axis=1)
    return order, best


def describe(found: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Adds pivots (nearest first) and ball: the nearest pivot where it is within half of the
    threshold's angle, else null.  A length without pivots has one list of its own."""
    shared = found.sparkSession.sparkContext.broadcast(pivots)  # MAX_PIVOTS rows at most
    within = np.cos(np.arccos(threshold) / 2 - 1e-7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {n: sum(len(p) for m, p in sorted(shared.value.items()) if m < n) for n in shared.value}
        for batch in batches:
            rows = batch.to_pylist()
            for n in {len(r["vec"]) for r in rows}:
                own = [r for r in rows if len(r["vec"]) == n]
                if n not in first:
                    yield pa.RecordBatch.from_pylist([r | {"pivots": [-n], "ball": None} for r in own], schema=schema)
                    continue
                order, best = nearest_pivots(unit([r["vec"] for r in own]), shared.value[n])
                near = best >= within
                yield pa.RecordBatch.from_pylist([r | {"pivots": (o + first[n]).tolist(), "ball": int(o[0] + first[n]) if b else None} for r, o, b in zip(own, order, near, strict=True)], schema=schema)

    schema = pa.schema([("key", pa.int64()), ("vec", pa.list_(pa.float64())), ("copies", pa.int64()), ("pivots", pa.list_(pa.int32())), ("ball", pa.int32())])
    return materialise(found.select("key", "vec", "copies").mapInArrow(run, DESCRIBED), "described")


def cells(described: DataFrame) -> DataFrame:
    """Every entry in the cells where it is compared: (list, a, b, side) with its columns.

    Two vectors that share SHARED pivots have their first common one, in the pivots' order, among
    all but the last SHARED - 1 of each, so the others are not posted.  Within a list the entries of a
    ball stand in blocks of their own, which never meet blocks of the same ball.
    """
    # A vector with fewer pivots (few there are) posts all: it needs fewer in common.
    need = F.least(F.size("pivots"), F.lit(SHARED))
    post = F.slice(F.array_sort("pivots"), F.lit(1), F.size("pivots") - need + 1)
    posted = described.withColumn("list", F.explode(post))
    sizes = posted.groupBy("list", "ball").agg(F.count("*").alias("n"))
    blocks = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # The blocks of a list in order: those of no ball, then ball by ball.  A list has few balls.
    whole = blocks.groupBy("list").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct(F.coalesce("ball", F.lit(-1)).alias("of"), "blocks"))).alias("parts"))
    dealt = posted.join(whole, "list")
    own = F.coalesce("ball", F.lit(-1))
    mine = F.element_at(F.filter("parts", lambda p: p["of"] == own), 1)["blocks"]
    before = F.aggregate(F.filter("parts", lambda p: p["of"] < own), F.lit(0), lambda n, p: n + p["blocks"])
    total = F.aggregate("parts", F.lit(0), lambda n, p: n + p["blocks"])
    dealt = dealt.withColumn("block", before + F.pmod(F.xxhash64("key"), mine).cast("int")).withColumn("before", before).withColumn("mine", mine)
    # Small lists are one cell; else the blocks met are all but the others of the own ball.
    others = F.filter(F.sequence(F.lit(0), total - 1), lambda b: (own == -1) | (b < F.col("before")) | (b >= F.col("before") + F.col("mine")))
    met = F.when(F.col("all") <= BLOCK, F.array(F.lit(-1))).otherwise(F.array_distinct(others))
    out = dealt.withColumn("other", F.explode(met))
    alone = F.col("other") == -1
    return out.select(
        "list",
        F.when(alone, -1).otherwise(F.least("block", "other")).alias("a"),
        F.when(alone, -1).otherwise(F.greatest("block", "other")).alias("b"),
        (~alone & (F.col("block") > F.col("other"))).alias("right"),
        "key", "vec", "copies", "pivots", "ball",
    )


def shared_pivots(lists: list[list[int]], l: np.ndarray, r: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """How many pivots each of the rows ``l`` shares with each of ``r``, and how many of those come before ``at``.

    Pivots of one side only add nothing; the others are marked in slices that hold HELD numbers at most.
    """
    rows = np.repeat(np.arange(len(lists)), [len(row) for row in lists])
    flat = np.array([p for row in lists for p in row])
    names = np.intersect1d(flat[np.isin(rows, l)], flat[np.isin(rows, r)])
    shared, earlier = np.zeros((len(l), len(r)), np.float32), None
    cut = int(np.searchsorted(names, at))
    step = max(1, HELD // max(1, len(lists)))
    starts = [*range(0, cut, step), *range(cut, len(names), step)]
    for start, end in zip(starts, [*starts[1:], len(names)], strict=True):
        if start == cut:
            earlier = shared.copy()
        own = (flat >= names[start]) & (flat <= names[end - 1]) & np.isin(flat, names[start:end])
        has = np.zeros((len(lists), end - start), dtype=np.float32)
        has[rows[own], np.searchsorted(names[start:end], flat[own])] = 1
        shared += has[l] @ has[r].T
    return shared, shared if earlier is None else earlier


def linked_in_cell(cell: pa.Table, threshold: float) -> pa.Table:
    """Of one cell, per entry with links: their weight, and the least key it is connected to.

    A pair counts only in the list of the first pivot that both have posted.
    """
    at = cell.column("list")[0].as_py()
    right = cell.column("right").to_numpy(zero_copy_only=False)
    key, copies = cell.column("key").to_numpy(), cell.column("copies").to_numpy()
    ball = cell.column("ball").fill_null(-1).to_numpy()
    x = unit(cell.column("vec").to_pylist())
    lists = cell.column("pivots").to_pylist()
    l, r = (np.flatnonzero(~right), np.flatnonzero(right)) if right.any() else (np.arange(len(key)), np.arange(len(key)))
    size = np.array([len(row) for row in lists])
    need = np.minimum(np.minimum(size[l][:, None], size[r][None, :]), SHARED)
    shared, earlier = shared_pivots(lists, l, r, at)
    ok = (shared >= need) & (earlier == 0)
    ok &= (ball[l][:, None] < 0) | (ball[l][:, None] != ball[r][None, :])
    ok &= key[l][:, None] != key[r][None, :]
    ok &= x[l] @ x[r].T >= threshold
    if not ok.any():
        return pa.table({"key": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
    links = np.zeros(len(key), dtype=np.int64)
    links[l] += ok @ copies[r]
    if right.any():
        links[r] += ok.T @ copies[l]
    least, far = key.copy(), np.iinfo(np.int64).max
    while True:  # labels spread along links until they rest
        low = least.copy()
        np.minimum.at(low, l, np.where(ok, least[r][None, :], far).min(axis=1))
        np.minimum.at(low, r, np.where(ok, low[l][:, None], far).min(axis=0))
        if (low == least).all():
            break
        least = low
    some = np.flatnonzero(links)
    return pa.table({"key": key[some], "links": links[some], "least": least[some]})


def near_links(described: DataFrame, threshold: float) -> DataFrame:
    """key, links, least: what the cells and the balls find, several rows a key."""
    # Dealt by cell, or Spark would leave all cells of a list where the list's entries met.
    tasks = int(described.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cells(described).repartition(tasks, "list", "a", "b").groupBy("list", "a", "b").applyInArrow(lambda cell: linked_in_cell(cell, threshold), FOUND)
    balls = described.filter("ball IS NOT NULL").groupBy("ball").agg(F.sum("copies").alias("weight"), F.min("key").alias("least"))
    inside = described.select("key", "copies", "ball").join(balls, "ball").filter("weight > copies")
    return found.union(inside.select("key", (F.col("weight") - F.col("copies")).alias("links"), "least"))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    own = entries(vectors, id_col, vec_col)
    links = materialise(near_links(describe(own, choose_pivots(own), threshold), threshold), "links")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("key").alias("u"), F.col("least").alias("v")))
    placed = own.join(counts, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    placed = materialise(placed.select("vec", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component")), "placed")
    named = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = placed.join(named, "component").select(F.col("vec").alias("of"), "n_links", "component_id")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    out = rows.join(placed, F.col("vec") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
