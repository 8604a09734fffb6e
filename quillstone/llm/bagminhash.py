"""Near duplicates by BagMinHash over weighted 5-word shingles.

A text is the multiset of its 5-word windows (words are split at ASCII white space,
A-Z lower-cased).  For every shingle of weight w the weight axis is cut at 0, 1, 2, 4,
8, ...; each interval that begins below w carries a Poisson process whose rate is the
interval's width.  Processes are hierarchical: each gives its first point, an arrival
time with a register, and is then split into its halves.  One half, chosen by a random
bit, holds the point; the other goes on from that time with a process of its own.  A half
that begins at w or above is dropped, and a point counts once its half ends at w or
below.  Only unit cells go on with further points.  All of it is a function of (shingle,
interval, number), so texts share points exactly as far as their weights overlap, and two
registers agree with the weighted Jaccard similarity as probability.  Processes stop once
their next arrival is later than the worst register, so long texts cost little more than
one point a shingle.

Signatures are cut into bands.  Texts with equal multisets (a 256-bit digest) are one
node.  Of a bucket's nodes one is the centre.  In a round every node meets one centre at
most: of those of another component that it has not met, the one of most of its buckets.
The pairs are verified by the exact multiset overlap of the whole texts.  Components are contracted, a
bucket within one component is done with, and others get a new centre.  Rounds go on
while one pair in ``YIELD`` gives a link, so a family of near copies costs a few rows a
node however large it is.

What is then still apart is settled exactly, in buckets of any size (``exact_pairs``).  A
shingle that more than HEAVY of these nodes have is heavy.  Nodes that share a shingle
that is not heavy meet by it, whatever their bucket; only the pairs whose shared light
shingles, with all the heavy ones the smaller heavy part can add, may reach the
threshold are verified.  Pairs without a light shingle in common are near by their
heavy parts alone.  If x and y are, x is also near to the smallest node whose heavy
part is that of y, and so is y; so each node of a bucket is compared with the smallest
node of each heavy part that is large enough.  That is linear where a family shares a
template, and grows with the square of a bucket only where its nodes are of several
components, their heavy parts all differ and are most of each text.  HEAVY and YIELD
move work between the steps; every value gives the same classes.

Defined results.  Null text counts as empty; texts without words are copies of one
another.  A text of under five words has one shingle, all its words.  The class of a
document is the least identifier of its component; ties between equal texts go to it
too.  A null identifier is left out of the classes and its row has a null class.  Rows
that repeat an identifier are classed each by its own text.  Texts of any length are
read whole.  An empty table gives an empty result.  Only the identifier and text columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quillstone.llm.components import components
from quillstone.llm.exact_dedup import BLOOM
from quillstone.llm.rows import as_batch, free_names, map_rows
from quillstone.sources.workspace import materialise, settings

WORDS = 5
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Nodes from which on a shingle is heavy in the exact step.
HEAVY = 32
#: Rounds of centres go on while one verified pair in so many is a link.
YIELD = 20
#: Texts hashed together in a task.
BATCH = 512

SIGNATURE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("content", pa.binary()), ("bands", pa.list_(pa.int64()))])
BAG = pa.schema([("node", pa.int64()), ("shingles", pa.binary()), ("counts", pa.binary())])
ELEMENTS = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("size", pa.int64()), ("elements", pa.list_(pa.int64()))])
VERDICT = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("similarity", pa.float64())])

U = np.uint64
GOLDEN = 0x9E3779B97F4A7C15


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the text's 5-word windows, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, U)
    for k in range(min(WORDS, len(words))):
        out = mix(out * U(3) + h[k : k + n] + U(k))
    return out


def multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and how often each occurs."""
    return np.unique(shingles(text), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of greatest counts; 1 for two empty multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole else 1.0


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of ``registers`` arrival times for each multiset that is not empty; the
    row of an empty one stays infinite."""
    best = np.full((len(sets), registers), np.inf)
    if not any(len(s) for s, _ in sets):
        return best
    size = np.array([len(s) for s, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    element = np.concatenate([s for s, _ in sets])
    text = np.repeat(np.arange(len(sets)), size)
    # Intervals [0, 1), [1, 2), [2, 4), ... that begin below the weight.
    levels = np.where(weight > 1, np.ceil(np.log2(weight)).astype(np.int64), 0) + 1
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    seed = mix(np.repeat(element, levels) + (level.astype(U) + U(1)) * U(GOLDEN))
    text, weight = np.repeat(text, levels), np.repeat(weight, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width, number = np.maximum(low, 1), np.ones(len(seed), U)
    time, register = next_point(seed, number, width, np.zeros(len(seed)), registers)
    flat, worst, new = best.reshape(-1), np.full(len(sets), np.inf), np.ones(len(seed), bool)
    while True:
        live = time < worst[text]
        text, weight, low, width, seed, number, time, register, new = (x[live] for x in (text, weight, low, width, seed, number, time, register, new))
        if not len(seed):
            return best
        counts = new & (low + width <= weight)
        np.minimum.at(flat, (text * registers + register)[counts], time[counts])
        worst = best.max(axis=1)
        # A unit cell goes on with its next point; a wider process is split.
        cell = width == 1
        number = np.where(cell, number + U(1), number)
        after = next_point(seed[cell], number[cell], width[cell], time[cell], registers)
        new &= ~counts
        whole, half = np.flatnonzero(~cell), width[~cell] // 2
        side = (mix(seed[whole] ^ U(GOLDEN)) & U(1)).astype(np.int64)
        other = mix(seed[whole] + (U(3) - side.astype(U)) * U(GOLDEN))
        beside = low[whole] + (1 - side) * half
        first = next_point(other, np.ones(len(whole), U), half, time[whole], registers)
        seed[whole], low[whole], width[whole] = mix(seed[whole] + (U(2) + side.astype(U)) * U(GOLDEN)), low[whole] + side * half, half
        number[whole] = U(1)
        time[cell], register[cell], new[cell] = *after, True
        joined = ((text, text[whole]), (weight, weight[whole]), (low, beside), (width, half), (seed, other), (number, np.ones(len(whole), U)), (time, first[0]), (register, first[1]), (new, np.ones(len(whole), bool)))
        text, weight, low, width, seed, number, time, register, new = (np.concatenate(x) for x in joined) if len(whole) else (x[0] for x in joined)
        inside = low < weight
        if not inside.all():
            text, weight, low, width, seed, number, time, register, new = (x[inside] for x in (text, weight, low, width, seed, number, time, register, new))


def next_point(seed: np.ndarray, number: np.ndarray, width: np.ndarray, time: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrival time and register of a process's point of that number, the one before at ``time``."""
    z = mix(seed + number * U(GOLDEN))
    gap = -np.log(((z >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
    return time + gap / width, ((mix(z ^ U(GOLDEN)) >> U(40)) % U(registers)).astype(np.int64)


def band_keys(best: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; it also depends on the band's number."""
    bits = best.view(U).reshape(len(best), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=U) * U(GOLDEN), bits.shape[:2])
    for k in range(rows):
        key = mix(key * U(5) + bits[:, :, k])
    return key.view(np.int64)


def digest(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Tells multisets apart: SHA-256 of shingles and counts."""
    return sha256(bag[0].tobytes() + bag[1].tobytes()).digest()


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64), content (digest of the multiset), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [multiset(t or "") for t in part.column(2).to_pylist()]
                bands = band_keys(signatures(sets))
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), map(digest, sets), (b if len(s[0]) else [] for b, s in zip(bands, sets, strict=True)), strict=True)
                yield as_batch(list(rows), SIGNATURE)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), text_col).mapInArrow(run, from_arrow_schema(SIGNATURE))


def bags(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles, counts of the nodes of ``members`` (node, least, content), from the whole texts."""

    def row(node, content, text) -> Iterator[tuple]:
        bag = multiset(text or "")
        if digest(bag) == content:
            yield node, bag[0].tobytes(), bag[1].tobytes()

    # The no-op condition lets Spark build its runtime filter of texts on the members' side.
    members = materialise(members, "near-members").filter("least >= -9223372036854775808")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with settings(docs.sparkSession, BLOOM):
        found = map_rows(own.join(members, F.col("id") == F.col("least")), ["node", "content", "text"], row, BAG, batch_rows=256)
        return materialise(found.dropDuplicates(["node"]), "near-bags", compression="zstd")


def bag_of(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(shingles, U), np.frombuffer(counts, np.int64)


def verify(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """u, v, similarity of each pair, from the multisets of the whole texts."""

    def row(u, v, a, b) -> Iterator[tuple]:
        yield u, v, weighted_jaccard(bag_of(**a), bag_of(**b))

    def side(node: str, bag: str) -> DataFrame:
        return own.select(F.col("node").alias(node), F.struct("shingles", "counts").alias(bag))

    return map_rows(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v"), ["u", "v", "a", "b"], row, VERDICT)


def with_weights(entries: DataFrame) -> DataFrame:
    """Adds weight: the entries of all of a node's buckets.

    Of a family of copies the text that most others are near to is in its largest
    buckets, so weight tells it from the outer ones.
    """
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
    weights = entries.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("weight"))
    return entries.join(weights, "node")


def centre_pairs(apart: DataFrame, tested: DataFrame | None, turn: int) -> DataFrame:
    """Each node with one centre of another component: the one it shares most buckets
    with, which tells of their similarity, among those not tested.

    A centre is a bucket's node of largest weight; after the first turn the weights are
    times for which nodes race, so that lighter ones get their turn.  Centres are found by
    partial aggregation; a bucket's nodes meet theirs in a join that Spark may split.
    """
    luck = (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    rank = -F.col("weight") if turn == 0 else -F.log(luck) / F.col("weight") ** 2
    centres = apart.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "component")).alias("c"))
    met = apart.join(centres, "key").filter("component <> c.component").groupBy("node", F.col("c.node").alias("centre")).agg(F.count("*").alias("n"))
    pairs = met.select("node", "n", F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v"))
    if tested is not None:
        pairs = pairs.join(tested, ["u", "v"], "left_anti")
    return pairs.groupBy("node").agg(F.max_by(F.struct("u", "v"), F.struct("n", "u", "v")).alias("p")).select("p.*").distinct()


def elements(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The multiset as a set: a key for each occurrence of each shingle."""
    s, w = bag
    occurrence = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    return mix(np.repeat(s, w) + occurrence.astype(U) * U(GOLDEN)).view(np.int64)


def exact_pairs(apart: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """A superset of the pairs across components, in buckets of ``apart``, that reach the
    threshold, and small enough to be verified; see above."""

    def row(node, component, shingles, counts) -> Iterator[tuple]:
        keys = elements(bag_of(shingles, counts))
        yield node, component, len(keys), keys

    def may_reach(shared, a: str, b: str):
        # An overlap o of sizes a and b reaches t where o (1 + t) >= t (a + b).
        return shared * (1 + threshold) >= threshold * (F.col(a) + F.col(b)) - 1e-6

    nodes = apart.select("node", "component").distinct()
    spread = map_rows(nodes.join(own, "node"), ["node", "component", "shingles", "counts"], row, ELEMENTS, batch_rows=64)
    each = materialise(spread.select("node", "component", "size", F.explode("elements").alias("element")), "near-elements", compression="zstd")
    counts = each.groupBy("element").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b"))
    counts = counts.filter((F.col("n") > HEAVY) | (F.col("a") < F.col("b"))).select("element", (F.col("n") > HEAVY).alias("heavy"))
    shared = materialise(each.join(counts, "element"), "near-shared", compression="zstd")

    # Heavy parts are told apart by three sums over 32 bits each of their keys.
    halves = F.struct(F.sum(F.shiftright("element", 32)), F.sum(F.col("element").bitwiseAND(0xFFFFFFFF)), F.sum(F.col("element").bitwiseXOR(F.shiftright("element", 17)).bitwiseAND(0xFFFFFFFF)))
    heavy = shared.filter("heavy").groupBy("node").agg(F.count("*").alias("h"), halves.alias("part"))
    units = each.groupBy("node").agg(F.first("size").alias("size")).join(heavy, "node", "left")
    units = materialise(units.select("node", "size", F.coalesce("h", F.lit(0)).alias("h"), "part"), "near-units")

    left = shared.filter("NOT heavy").select("element", "node", "component", "size")
    right = left.select("element", *[F.col(c).alias(f"{c}2") for c in ("node", "component", "size")])
    met = left.join(right, "element").filter("component < component2").filter(may_reach(F.least("size", "size2"), "size", "size2"))
    met = met.groupBy("node", "size", "node2", "size2").agg(F.count("*").alias("o"))
    parts = units.select("node", "h")
    met = met.join(parts, "node").join(parts.select(F.col("node").alias("node2"), F.col("h").alias("h2")), "node2")
    light = met.filter(may_reach(F.col("o") + F.least("h", "h2"), "size", "size2")).select("node", "node2")

    able = units.filter(F.col("h") >= threshold * F.col("size") - 1e-6)
    able = apart.select("key", "node", "component").join(able, "node")
    least = able.groupBy("key", "part").agg(F.min(F.struct("size", "node", "component", "h")).alias("s"))
    least = least.select("key", F.col("s.node").alias("node2"), F.col("s.component").alias("component2"), F.col("s.size").alias("size2"), F.col("s.h").alias("h2"))
    by_part = able.join(least, "key").filter("component <> component2").filter(may_reach(F.least("h", "h2"), "size", "size2")).select("node", "node2")
    return light.union(by_part).select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v"))


def still_apart(entries: DataFrame, found: DataFrame | None, before: DataFrame | None = None) -> DataFrame:
    """Entries, with components, of the buckets that span several; ``before`` are those of the last turn."""
    if found is None:
        return entries.withColumn("component", F.col("node"))
    marked = entries.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    buckets = marked.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    return materialise(marked.join(buckets.select("key"), "key"), "near-open", replaces=before)


def content_classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows, and content, class_id, node_id of each distinct multiset."""
    signed = materialise(sign(docs, id_col, text_col), "near-signatures")
    nodes = signed.groupBy("content").agg(F.min("doc_id").alias("least"), F.max("bands").alias("bands")).filter("least IS NOT NULL")
    # Numbers of this table, written before anything reads them.
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    several = entries.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("key")
    entries = materialise(with_weights(materialise(entries.join(several, "key"), "near-buckets")), "near-entries")
    own = bags(docs, nodes.select("node", "least", "content").join(entries.select("node").distinct(), "node"), id_col, text_col)

    found = tested = None

    def link(pairs: DataFrame) -> bool:
        """Verify pairs not seen before; whether enough of them were links."""
        nonlocal found, tested
        pairs = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["u", "v"], "left_anti")
        judged = materialise(verify(pairs, own), "near-judged")
        near = F.col("similarity") >= threshold
        links = judged.filter(near).select("u", "v")
        tested = judged.select("u", "v") if tested is None else tested.union(judged.select("u", "v"))
        seen = judged.agg(F.count("*").alias("n"), F.count_if(near).alias("near")).first()
        if seen["near"]:
            # Components so far stand for the links that made them.
            before = [] if found is None else [found.select(F.col("node").alias("u"), F.col("component").alias("v"))]
            found = components(reduce(DataFrame.union, before, links))
        return seen["near"] * YIELD > seen["n"]

    turn, apart = 0, still_apart(entries, None)
    while link(centre_pairs(apart, tested, turn)):
        turn, apart = turn + 1, still_apart(entries, found, apart)
    if found is not None:
        apart = still_apart(entries, found, apart)
    link(exact_pairs(apart, own, threshold))

    classes = nodes.select("content", "node", "least")
    if found is None:
        return signed, classes.select("content", F.col("least").alias("class_id"), F.col("least").alias("node_id"))
    classes = materialise(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-classes")
    names = classes.groupBy("component").agg(F.min("least").alias("class_id"))
    return signed, classes.join(names, "component").select("content", "class_id", F.col("least").alias("node_id"))


def near_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, node_id (least identifier of its equal multisets)."""
    signed, classes = content_classes(docs, threshold, id_col, text_col)
    return signed.select("doc_id", "content").join(classes, "content", "left").select("doc_id", F.expr("CASE WHEN doc_id IS NOT NULL THEN class_id END").alias("class_id"), "node_id")


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one whose identifier names the class.

    Rows are judged each by its own text, also where they repeat an identifier.
    """
    signed, classes = content_classes(docs, threshold, id_col, text_col)
    gone, hashed = free_names(docs, "gone", "hash")
    out = signed.join(classes, "content").filter("doc_id <> class_id").select(F.col("doc_id").alias(gone), F.col("text_hash").alias(hashed)).distinct()
    return docs.join(out, (F.col(id_col) == F.col(gone)) & (F.xxhash64(text_col) == F.col(hashed)), "left_anti")
