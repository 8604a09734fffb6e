"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bagminhash, bpe, exact_dedup, html_extract, packing, pivot_index, quality_rules, quotation_linking, role_repair, secret_scan, spelling_variants, suffix_dedup, toxicity
from quillstone.sources.workspace import tidy


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(documents(spark, sf_dir))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.near_classes(documents(spark, sf_dir))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces as op7 and the pipeline return them."""
    # byte_bpe_50k.tiktoken is the vocabulary of byte_bpe_50k.json in tiktoken's form.
    special = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_exact(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_linking.link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return role_repair.repair_report(rows).select("conv_id", "gaps", *role_repair.COUNTS, "cost", "audit", "repaired_sha256")


def op12_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

#: The table of CRC-32, byte by byte, and the checksum of a string in DuckDB.
CRC_TABLE = """tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) x(i)))"""


def crc32_sql(key: str) -> str:
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, 1 + octet_length(encode({key}))), lambda i: ('0x' || substr(hex(encode({key})), 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"


OP11_SQL = f"""WITH RECURSIVE {CRC_TABLE},
  o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations, tab),
  g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE d <> 0),
  n AS (SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, role[1] AS i, lag(role[1]) OVER w AS before, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS e
    FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
  f AS MATERIALIZED (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
  c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n_rows, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
  -- the grammar: from an item an edit of a turn with an initial, or any, to the next item
  m(item, edit, initial, onward, put) AS (VALUES ('open', 'K', 's', 'said', ''), ('open', 'K', 'u', 'asked', ''), ('said', 'K', 'u', 'asked', ''), ('asked', 'K', 'a', 'answered', ''), ('answered', 'K', 'u', 'asked', ''),
    ('open', 'R', NULL, 'asked', 'user'), ('said', 'R', NULL, 'asked', 'user'), ('asked', 'R', NULL, 'answered', 'assistant'), ('answered', 'R', NULL, 'asked', 'user'),
    ('open', 'D', NULL, 'open', ''), ('said', 'D', NULL, 'said', ''), ('asked', 'D', NULL, 'asked', ''), ('answered', 'D', NULL, 'answered', '')),
  x(item, ins, onward, put) AS (VALUES ('open', '', 'open', []), ('said', '', 'said', []), ('asked', '', 'asked', []), ('answered', '', 'answered', []), ('open', 'I', 'asked', ['user:']), ('said', 'I', 'asked', ['user:']), ('asked', 'I', 'answered', ['assistant:']), ('answered', 'I', 'asked', ['user:']),
    ('open', 'II', 'answered', ['user:', 'assistant:']), ('said', 'II', 'answered', ['user:', 'assistant:'])),
  -- the least (cost, audit) of each item before each turn, and the lines it has put out
  s AS (SELECT c.conv_id, 1::BIGINT AS k, x.onward AS item, {{'cost': 3 * length(ins), 'audit': ins, 'lines': x.put}} AS best FROM c, x WHERE x.item = 'open'
    UNION ALL SELECT s.conv_id, s.k + 1, x.onward, min({{'cost': best.cost + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END + 3 * length(ins), 'audit': best.audit || edit || ins,
      'lines': best.lines || CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [m.put || ':' || text] END || x.put}})
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k JOIN m ON m.item = s.item AND (m.initial IS NULL OR m.initial = f.i) AND (m.edit = 'D' OR fault NOT IN ('blank', 'duplicate')) JOIN x ON x.item = m.onward GROUP BY 1, 2, 3),
  z AS (SELECT s.conv_id, min(best) AS best FROM s JOIN c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.k = c.n_rows + 1 WHERE s.item IN ('open', 'answered') GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""

OP12_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
  c AS (SELECT vec_id, vec_id AS root FROM e UNION SELECT c.vec_id, l.w FROM c JOIN l ON l.u = c.root),
  n AS (SELECT u, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept FROM c LEFT JOIN n ON n.u = vec_id GROUP BY vec_id, n_links"""

OP13_SQL = f"""WITH RECURSIVE {CRC_TABLE},
  r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
  d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2), h AS (SELECT run, n, {crc32_sql("doc_id || ':' || run")} AS h FROM d, tab WHERE length(run) >= 7),
  w AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
  v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
  k AS MATERIALIZED (SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: word[:i - 1] || '*' || word[i + 1:])) AS hole, unnest(list_transform(range(1, length(word) + 1), lambda i: word[:i - 1] || word[i + 1:])) AS less FROM v),
  p AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.hole = b.hole AND a.word <> b.word
    UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.less UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.less),
  q AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k FROM p),
  f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN q ON q.word = v.word AND k = 1),
  s AS (SELECT word, word AS root FROM f UNION SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word JOIN f e ON e.word = s.root WHERE e.form IS NULL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scan, op2_quality_rules, op3_suffix_dedup, op4_bpe, op5_toxicity, op6_bagminhash, op7_packing, op8_exact_dedup,
        op9_quotation_linking, op10_html_extract, op11_role_repair, op12_pivot_index, op13_spelling_variants,
    )
    return {run.__name__: tidy(run) for run in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op11_role_repair": OP11_SQL, "op12_pivot_index": OP12_SQL, "op13_spelling_variants": OP13_SQL}
