"""Dense, lexical and fused retrieval, evidence checks and index maintenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.workspace import materialise, settings

#: Queries and vectors compared together, about.
QUERY_BLOCK = 1024
VECTOR_BLOCK = 4096
#: Similarities that a task holds at once, about.
HELD = 1 << 18
#: A pair of blocks is a megabyte or more, so that Spark's usual batch of 10,000 rows would hold all of a task.
PAIR_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Terms of all queries that a scan carries along.
FEW_TERMS = 1000
RANKED = "query long, id long, similarity double"


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, same_ids: bool = True) -> DataFrame:
    """query, id, similarity (9 decimals), rank: exact cosine neighbours of a stated query set.

    With ``same_ids`` a query's identifier is that of its own vector, which is no answer to it.

    Both have (id, vector).  Queries and vectors are packed into blocks of about
    ``QUERY_BLOCK`` and ``VECTOR_BLOCK`` rows by a hash of their ids, and every query block
    meets every vector block once, in any task; of each such pair k rows per query go on.
    """

    pairs = packed(vectors, VECTOR_BLOCK, "own").crossJoin(packed(queries, QUERY_BLOCK, "asked")).select("asked", "own")
    return nearest(pairs, k, same_ids)


def nearest(pairs: DataFrame, k: int, same_ids: bool) -> DataFrame:
    """query, id, similarity, rank: the k best per query over pairs of packed blocks (asked, own), a few pairs in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, own in zip(batch.column(0), batch.column(1), strict=True):
                yield nearest_in_block(*unpacked(asked), *unpacked(own), k, same_ids)

    with settings(pairs.sparkSession, PAIR_BATCH):
        return materialise(top(pairs.mapInArrow(run, RANKED), "similarity", k), "nearest")


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, vector) without null vectors in blocks of about ``size``: one array column."""
    rows = rows.filter("vector IS NOT NULL").select("id", "vector")
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    return dealt.agg(F.collect_list(F.struct("id", "vector")).alias(name)).select(name)


def unpacked(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block."""
    rows = block.values
    ids = rows.field("id").to_numpy(zero_copy_only=False).astype(np.int64)
    x = rows.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest_in_block(ids: np.ndarray, block: np.ndarray, own: np.ndarray, x: np.ndarray, k: int, same_ids: bool) -> pa.RecordBatch:
    """The k nearest vectors of a block per query of a block, ties by id."""
    found, step = [], max(1, HELD // len(own))
    for at in range(0, len(ids), step):
        some = ids[at : at + step]
        s = np.round(block[at : at + step] @ x.T, 9)
        s[np.isnan(s)] = -3.0
        if same_ids:
            s[some[:, None] == own[None, :]] = -3.0
        # All that tie with the k-th go on; only they are sorted.
        least = np.partition(s, -k, axis=1)[:, -k:].min(axis=1, keepdims=True) if k < len(own) else -3.0
        row, col = np.nonzero((s >= least) & (s > -3.0))
        order = np.lexsort((own[col], -s[row, col], row))
        row, col = row[order], col[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[first], col[first]
        found.append((some[row], own[col], s[row, col]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query", "id", "similarity"])


def top(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The first k per query by falling score, then id; Spark cuts before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(score), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def terms(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, term, tf of lower-cased words."""
    words = texts.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(text_col), "[ \n]+")).alias("term")).filter("term <> ''")
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf(postings: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf of BM25."""
    counted = postings.groupBy("term").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25(texts: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, id, score of every text that shares a term with a query.

    One scan counts the texts' words.  Where the queries have at most ``FEW_TERMS`` terms, only those
    words leave the row; more of them meet the exploded words in a join.
    """
    wanted = terms(queries, "id").select(F.col("id").alias("query"), "term")
    words = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda w: w != "")
    counted = texts.select("id", words.alias("words")).withColumn("len", F.size("words"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    few = [r["term"] for r in wanted.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        each = counted.select("id", "len", F.explode(F.filter("words", lambda w: w.isin(few) if few else F.lit(False))).alias("term"))
    else:
        each = counted.select("id", "len", F.explode("words").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    postings = materialise(each.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "postings")
    matched = postings.join(wanted, "term").join(idf(postings, stats["n"]), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats["mean"])))
    return matched.groupBy("query", "id").agg(F.round(F.sum(part), 6).alias("score"))


def fused(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query, id, rank)."""
    both = first.select("query", "id", F.col("rank").alias("a")).join(second.select("query", "id", F.col("rank").alias("b")), ["query", "id"], "full_outer")
    parts = [F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in ("a", "b")]
    return both.withColumn("score", F.round(parts[0] + parts[1], 9))


def overlap(queries: DataFrame, texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Lexical rerank score of candidates: the share of the query's distinct terms in the text.

    Only texts that are a candidate are split.
    """
    q = queries.select(F.col("id").alias("query"), F.array_distinct(F.split(F.lower("text"), "[ \n]+")).alias("q"))
    few = texts.join(candidates.select("id").distinct(), "id", "left_semi")
    t = few.select("id", F.array_distinct(F.split(F.lower("text"), "[ \n]+")).alias("t"))
    joined = candidates.join(q, "query").join(t, "id")
    return joined.withColumn("overlap", F.round(F.size(F.array_intersect("q", "t")) / F.size("q"), 6)).drop("q", "t")


def grouped_metrics(ranked: DataFrame, n_relevant: DataFrame, k: int) -> DataFrame:
    """Metrics per query from ranked rows (query, rank, relevant) and set sizes (query, n_relevant)."""
    in_k = F.col("rank") <= k
    hit = F.col("relevant") & in_k
    counted = ranked.groupBy("query").agg(
        F.count_if(hit).alias("hits"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.coalesce(F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg")
    )
    joined = n_relevant.join(counted, "query", "left").na.fill({"hits": 0, "dcg": 0.0})
    best = F.least(F.col("n_relevant"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.when(best > 0, F.sequence(F.lit(1), best)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    return joined.select(
        "query",
        F.round(F.coalesce(F.try_divide("hits", "n_relevant"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.col("hits") / F.lit(k), 6).alias("precision"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.coalesce(F.try_divide(F.col("dcg"), ideal), F.lit(0.0)), 6).alias("ndcg"),
    )
