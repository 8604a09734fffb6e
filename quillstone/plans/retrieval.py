"""Retrieval queries: every id divisible by 100 is a query against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import ingest, retrieval
from quillstone.plans.catalogue import query
from quillstone.sources.tables import table

K = 10
DENSE = """WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity, q.label = e.label AS relevant
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s),
  t AS (SELECT * FROM r WHERE rank <= 10)"""


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def nearest(spark, sf_dir) -> DataFrame:
    return retrieval.dense_topk(vectors(spark, sf_dir), vectors(spark, sf_dir).filter("id % 100 = 0"), K)


@query(f"{DENSE} SELECT query, id, similarity, rank FROM t")
def dense_topk(spark, sf_dir) -> DataFrame:
    return nearest(spark, sf_dir)


def metrics(spark, sf_dir, k: int) -> DataFrame:
    """Relevant to a vector are the others with its label."""
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = label.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    asked = label.filter("vec_id % 100 = 0").join(n, "label").select(F.col("vec_id").alias("query"), F.col("label").alias("of"), "n_relevant")
    found = nearest(spark, sf_dir).join(asked.select("query", "of"), "query").join(label, F.col("id") == F.col("vec_id"))
    return retrieval.grouped_metrics(found.withColumn("relevant", F.col("label") == F.col("of")), asked.select("query", "n_relevant"), k)


def metric_sql(k: int) -> str:
    return f"""{DENSE}, n AS (SELECT q.vec_id AS query, (SELECT count(*) - 1 FROM embeddings e WHERE e.label = q.label) AS n_relevant FROM embeddings q WHERE q.vec_id % 100 = 0),
  h AS (SELECT query, count(*) FILTER (relevant AND rank <= {k}) AS hits, min(rank) FILTER (relevant) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (relevant AND rank <= {k}), 0) AS dcg FROM t GROUP BY 1),
  m AS (SELECT query, round(coalesce(hits / nullif(n_relevant, 0), 0), 6)::DOUBLE AS recall, round(hits / {k}, 6)::DOUBLE AS precision, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(coalesce(1 / first, 0), 6)::DOUBLE AS rr,
    round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(n_relevant, {k})) x(i)), 0), 6)::DOUBLE AS ndcg FROM n LEFT JOIN h USING (query))"""


@query(f"{metric_sql(10)} SELECT * FROM m")
def eval_per_query(spark, sf_dir) -> DataFrame:
    return metrics(spark, sf_dir, 10)


SUMMARY = ", ".join(f"round(coalesce(avg({m}), 0.0), 6) AS {m}" for m in ("recall", "precision", "hit", "rr", "ndcg"))


@query(f"{metric_sql(10)} SELECT count(*) AS n_queries, {SUMMARY} FROM m")
def eval_summary(spark, sf_dir) -> DataFrame:
    return metrics(spark, sf_dir, 10).agg(F.count("*").alias("n_queries"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in ("recall", "precision", "hit", "rr", "ndcg")])


@query(f"WITH a AS ({metric_sql(10)} SELECT avg(recall) AS base FROM m), b AS ({metric_sql(5)} SELECT avg(recall) AS now FROM m) SELECT round(base, 6) AS baseline, round(now, 6) AS current, base - now > 0.02 AS fails FROM a, b")
def eval_gate(spark, sf_dir) -> DataFrame:
    """Two runs' mean recall; a drop of over 2 points fails."""
    base = metrics(spark, sf_dir, 10).agg(F.avg("recall").alias("base"))
    now = metrics(spark, sf_dir, 5).agg(F.avg("recall").alias("now"))
    return base.join(now, F.lit(True)).select(F.round("base", 6).alias("baseline"), F.round("now", 6).alias("current"), (F.col("base") - F.col("now") > 0.02).alias("fails"))


WORDS = "SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS term FROM documents"
BM25 = f"""w AS ({WORDS}), p AS (SELECT id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2), l AS (SELECT d.doc_id AS id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN p ON p.id = d.doc_id GROUP BY 1),
  st AS (SELECT count(*) AS n, avg(len) AS mean FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  q AS (SELECT DISTINCT item_id AS query, unnest(string_split_regex(lower(text), '[ \\n]+')) AS term FROM benchmark WHERE item_id % 100 = 0),
  sc AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (id), st WHERE term <> '' GROUP BY 1, 2),
  bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 24)"""


def texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("id"), "text")


def lexical(spark, sf_dir) -> DataFrame:
    return retrieval.top(retrieval.bm25(texts(spark, sf_dir), questions(spark, sf_dir)), "score", 24)


@query(f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f, st")
def sparse_idf(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir)
    return retrieval.idf(retrieval.terms(docs, "id"), docs.count()).withColumn("idf", F.round("idf", 6))


@query(f"WITH {BM25} SELECT query, id, score, rank FROM bm")
def bm25_topk(spark, sf_dir) -> DataFrame:
    return lexical(spark, sf_dir)


LENGTHS = "le AS (SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score / (1 + id % 7) DESC, id) AS rank FROM bm) WHERE rank <= 24)"


def second_list(first: DataFrame) -> DataFrame:
    """Stand-in for the dense list of a text query (texts have no vectors): a damped order."""
    return retrieval.top(first.select("query", "id", (F.col("score") / (1 + F.col("id") % 7)).alias("damped")), "damped", 24)


@query(f"WITH {BM25}, {LENGTHS} SELECT query, id, round(coalesce(1.0 / (60 + bm.rank), 0) + coalesce(1.0 / (60 + le.rank), 0), 9)::DOUBLE AS score FROM bm FULL JOIN le USING (query, id)")
def rrf_fusion(spark, sf_dir) -> DataFrame:
    first = lexical(spark, sf_dir)
    return retrieval.fused(first, second_list(first)).select("query", "id", "score")


@query(
    f"""WITH {BM25}, o AS (SELECT bm.query, bm.id, round(len(list_intersect(list_distinct(string_split_regex(lower(b.text), '[ \\n]+')), list_distinct(string_split_regex(lower(d.text), '[ \\n]+')))) / len(list_distinct(string_split_regex(lower(b.text), '[ \\n]+'))), 6)::DOUBLE AS overlap
    FROM bm JOIN benchmark b ON b.item_id = query JOIN documents d ON d.doc_id = id) SELECT query, id, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY overlap DESC, id) AS rank FROM o) WHERE rank <= 6"""
)
def rerank_topn(spark, sf_dir) -> DataFrame:
    candidates = lexical(spark, sf_dir).select("query", "id")
    return retrieval.top(retrieval.overlap(questions(spark, sf_dir), texts(spark, sf_dir), candidates), "overlap", 6).select("query", "id", "overlap", "rank")


CITED = "(SELECT conv_id, turn, (conv_id * 10 + turn) % 900 AS doc_id FROM conversations WHERE role = 'assistant')"
SEEN = "(SELECT doc_id FROM documents WHERE lang = 'en')"


def citations(spark, sf_dir) -> DataFrame:
    """Stand-in: an assistant turn cites one document."""
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", ((F.col("conv_id") * 10 + F.col("turn")) % 900).alias("doc_id"))


def retrieved(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")


@query(f"SELECT * FROM {CITED} WHERE doc_id IN {SEEN}")
def citation_keep(spark, sf_dir) -> DataFrame:
    return citations(spark, sf_dir).join(retrieved(spark, sf_dir), "doc_id", "left_semi").select("conv_id", "turn", "doc_id")


@query(f"SELECT * FROM {CITED} WHERE doc_id NOT IN {SEEN}")
def citation_drop(spark, sf_dir) -> DataFrame:
    return citations(spark, sf_dir).join(retrieved(spark, sf_dir), "doc_id", "left_anti").select("conv_id", "turn", "doc_id")


@query("SELECT doc_id, nth FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS nth FROM documents) WHERE nth > 1")
def sha_dedupe(spark, sf_dir) -> DataFrame:
    """Uploads whose content is there already."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return ingest.first_of(hashed, ["sha256"], "doc_id").filter("nth > 1").select("doc_id", "nth")


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def embedding_cache_miss(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("sha256"))
    return docs.join(docs.filter("lang = 'en'").select("sha256"), "sha256", "left_anti").select("sha256").distinct()
