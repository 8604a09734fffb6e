"""Queries over texts' own vectors, claims and their evidence, and rounds of answering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import agent, embedding, evidence, retrieval
from quillstone.plans.catalogue import query
from quillstone.plans.retrieval import BM25, lexical, questions, texts
from quillstone.sources.tables import table
from quillstone.sources.workspace import materialise


def _vector_sql(name: str, rows: str, idf: str) -> str:
    """CTEs {name}_b (id, bucket, tf), ..., {name} (id, vector) of texts; ``idf`` names the corpus's CTE."""
    own = "" if idf != name else f"{name}_d AS (SELECT bucket, ln((1 + (SELECT count(*) FROM {rows})) / (1 + count(*)::DOUBLE)) + 1 AS idf, any_value((SELECT count(*) FROM {rows})) AS n FROM {name}_b GROUP BY 1),"
    return f"""{name}_t AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS word FROM {rows}) WHERE word <> '' GROUP BY 1, 2),
  {name}_x AS (SELECT id, tf, unnest(['w:' || word] || list_transform(range(1, length(word) + 1), lambda i: substr('<' || word || '>', i, 3))) AS feature FROM {name}_t),
  {name}_b AS (SELECT id, ('0x' || substr(md5(feature), 1, 4))::INT AS bucket, sum(tf) AS tf FROM {name}_x GROUP BY 1, 2), {own}
  {name}_s AS (SELECT id, bucket % 768 AS slot, sum((CASE WHEN (bucket // 768) % 2 = 0 THEN 1 ELSE -1 END) * (1 + ln(tf)) * coalesce(idf, ln(1 + (SELECT any_value(n) FROM {idf}_d)) + 1)) AS v FROM {name}_b LEFT JOIN {idf}_d USING (bucket) GROUP BY 1, 2),
  {name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY 1),
  {name} AS MATERIALIZED (SELECT g.id, list(coalesce(v / norm, 0) ORDER BY g.slot) AS vector FROM (SELECT id, norm, unnest(range(768)) AS slot FROM {name}_n) g LEFT JOIN {name}_s s ON s.id = g.id AND s.slot = g.slot GROUP BY 1)"""


DOCS = "(SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)"
ASKED = "(SELECT item_id AS id, text FROM benchmark WHERE item_id % 100 = 0)"


@query(f"WITH {_vector_sql('own', DOCS, 'own')} SELECT id AS doc_id, array_to_string(list_transform(vector, lambda x: round(x * 1000000)::BIGINT), ',') AS millionths FROM own")
def embed_texts(spark, sf_dir) -> DataFrame:
    """Every document's vector, its parts as millionths."""
    found = embedding.TextEmbedder(texts(spark, sf_dir)).embed(texts(spark, sf_dir))
    parts = F.transform("vector", lambda x: F.round(x * 1_000_000).cast("long").cast("string"))
    return found.select(F.col("id").alias("doc_id"), F.array_join(parts, ",").alias("millionths"))


@query(
    f"""WITH {BM25}, {_vector_sql("own", DOCS, "own")}, {_vector_sql("asked", ASKED, "own")},
    s2 AS (SELECT asked.id AS query, own.id AS id, round(list_cosine_similarity(asked.vector, own.vector), 9) AS similarity FROM asked, own),
    dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s2) WHERE rank <= 24)
    SELECT query, id, bm.rank AS lexical_rank, dn.rank AS dense_rank, round(coalesce(1.0 / (60 + bm.rank), 0) + coalesce(1.0 / (60 + dn.rank), 0), 9)::DOUBLE AS score FROM bm FULL JOIN dn USING (query, id)"""
)
def hybrid_search(spark, sf_dir) -> DataFrame:
    """Fusion of two retrievers over texts: BM25 and the cosine of their vectors."""
    return hybrid(spark, sf_dir)


def hybrid(spark, sf_dir) -> DataFrame:
    embedder = embedding.TextEmbedder(texts(spark, sf_dir))
    own = materialise(embedder.embed(texts(spark, sf_dir)), "text-vectors")
    dense = retrieval.dense_topk(own, embedder.embed(questions(spark, sf_dir)), 24, same_ids=False)
    words = lexical(spark, sf_dir)
    both = words.select("query", "id", F.col("rank").cast("long").alias("lexical_rank")).join(dense.select("query", "id", F.col("rank").cast("long").alias("dense_rank")), ["query", "id"], "full_outer")
    score = F.coalesce(1.0 / (60 + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("dense_rank")), F.lit(0.0))
    return both.withColumn("score", F.round(score, 9))


NEGATIONS = ", ".join(f"'{w}'" for w in evidence.NEGATIONS)


def _claims_sql() -> str:
    """j: one judged claim a row (conv_id, turn, claim_no, coverage, verdict)."""

    def tokens(text: str) -> str:
        return f"regexp_extract_all(lower({text}), '{evidence.TERM}')"

    def sentences(text: str) -> str:
        return f"list_filter(list_transform(regexp_extract_all({text}, '{evidence.SENTENCE}'), lambda s: trim(s)), lambda s: regexp_matches(s, '{evidence.TERM}'))"

    return f"""en AS (SELECT doc_id AS chunk, text FROM documents WHERE lang = 'en'),
  cs AS (SELECT conv_id, turn, text, (conv_id * 10 + turn) % 900 AS chunk FROM conversations WHERE role = 'assistant'),
  ds AS (SELECT doc_id AS chunk, {sentences('d.text')} AS s FROM documents d WHERE doc_id IN (SELECT chunk FROM cs)),
  an AS (SELECT conv_id, turn, cs.chunk, text || chr(10) || CASE WHEN conv_id % 3 = 0 THEN 'Not ' ELSE '' END || coalesce(s[1 + turn % len(s)], '') AS text FROM cs LEFT JOIN ds USING (chunk)),
  se AS (SELECT *, {sentences('text')} AS s FROM an),
  cl AS (SELECT conv_id, turn, chunk, unnest(range(len(s))) AS claim_no, unnest(s) AS claim FROM se),
  wt AS (SELECT conv_id, turn, claim_no, chunk, len({tokens('claim')}) AS n, unnest(list_distinct({tokens('claim')})) AS term FROM cl),
  dt AS (SELECT chunk, {tokens('text')} AS t FROM en), tf AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM dt) GROUP BY 1), nn AS (SELECT count(*) AS nd FROM en),
  wg AS (SELECT wt.*, ln(1 + (nd - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS weight, regexp_matches(term, '[0-9]') OR term IN ({NEGATIONS}) AS must FROM wt LEFT JOIN tf USING (term), nn),
  tt AS (SELECT conv_id, turn, claim_no, chunk, sum(weight) AS total, count(*) FILTER (must) AS musts, 2 * max(n) AS width, bool_or(term IN ({NEGATIONS})) AS negated FROM wg GROUP BY ALL),
  ws AS (SELECT chunk, unnest(range(len(t))) AS pos, unnest(t) AS term FROM dt WHERE chunk IN (SELECT chunk FROM cl)),
  hs AS MATERIALIZED (SELECT conv_id, turn, claim_no, chunk, pos, term, weight, must FROM ws JOIN wg USING (chunk, term)),
  ng AS (SELECT conv_id, turn, claim_no, chunk, pos FROM ws JOIN tt USING (chunk) WHERE NOT negated AND term IN ({NEGATIONS})),
  wn AS (SELECT a.conv_id, a.turn, a.claim_no, a.chunk, a.pos AS start, max(b.pos) AS last, count(DISTINCT b.term) FILTER (b.must) AS musts, list_sum(list_transform(list_distinct(list({{'t': b.term, 'w': b.weight}})), lambda x: x.w)) AS w
    FROM hs a JOIN tt USING (conv_id, turn, claim_no, chunk) JOIN hs b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.claim_no = a.claim_no AND b.pos >= a.pos AND b.pos < a.pos + width GROUP BY ALL),
  wi AS (SELECT wn.conv_id, wn.turn, wn.claim_no, round(w / total, 6) AS coverage, wn.musts = tt.musts AND NOT EXISTS (SELECT 1 FROM ng WHERE ng.conv_id = wn.conv_id AND ng.turn = wn.turn AND ng.claim_no = wn.claim_no AND ng.pos >= wn.start AND ng.pos < wn.last) AS fits FROM wn JOIN tt USING (conv_id, turn, claim_no, chunk)),
  bw AS (SELECT conv_id, turn, claim_no, max(coverage) AS coverage, bool_or(coverage >= {evidence.SHARE} AND fits) AS ok FROM wi GROUP BY ALL),
  j AS (SELECT cl.conv_id, cl.turn, cl.claim_no, coalesce(coverage, 0)::DOUBLE AS coverage, CASE WHEN chunk NOT IN (SELECT chunk FROM en) THEN 'INSUFFICIENT_EVIDENCE' WHEN coalesce(ok, false) THEN 'supported' ELSE 'unsupported' END AS verdict FROM cl LEFT JOIN bw USING (conv_id, turn, claim_no))"""


def judged_claims(spark, sf_dir) -> DataFrame:
    """Stand-in: an assistant turn cites one document (plans.retrieval) and ends by quoting a sentence of it,
    turned round in every third conversation; English documents are the ones retrieved."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "lang", "text")
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text", ((F.col("conv_id") * 10 + F.col("turn")) % 900).alias("chunk"))
    s = evidence.sentences(F.col("quoted"))
    quoted = materialise(evidence.chunks_of(docs.select("chunk", F.col("text").alias("quoted")), said).select("chunk", s.alias("s")), "quoted")
    quote = F.concat(F.when(F.col("conv_id") % 3 == 0, "Not ").otherwise(""), F.coalesce(F.try_element_at("s", (F.col("turn") % F.size("s") + 1).cast("int")), F.lit("")))
    answers = said.join(quoted.filter(F.size("s") > 0), "chunk", "left").select("conv_id", "turn", "chunk", F.concat("text", F.lit("\n"), quote).alias("text"))
    claims = materialise(evidence.split_claims(answers).withColumn("id", F.struct("conv_id", "turn", "claim_no")), "claims")
    return evidence.judge_claims(claims.select("id", "claim", "chunk"), docs.filter("lang = 'en'").select("chunk", "text")).select("id.conv_id", "id.turn", F.col("id.claim_no").cast("long").alias("claim_no"), "coverage", "verdict")


@query(f"WITH {_claims_sql()} SELECT * FROM j")
def claim_support(spark, sf_dir) -> DataFrame:
    return judged_claims(spark, sf_dir)


@query(f"WITH {_claims_sql()} SELECT conv_id, turn, count(*) AS n_claims, round(avg((verdict = 'supported')::INT), 6) AS groundedness, CASE WHEN bool_and(verdict = 'supported') THEN 'answered' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict FROM j GROUP BY ALL")
def groundedness(spark, sf_dir) -> DataFrame:
    return evidence.grounded(judged_claims(spark, sf_dir), ["conv_id", "turn"])


RISKY = "Licensed under"
TOOLS = {
    "qa": agent.Registered("query:run", 1, agent.search),
    "compare": agent.Registered("query:run", 2, agent.search),
    "multi_document": agent.Registered("query:run", 3, agent.search),
    "risk": agent.Registered("analysis:run", 1, agent.search_where(lambda text: text.contains(RISKY))),
    "summarize": agent.Registered("analysis:run", 1, agent.search),
    "extract": agent.Registered("analysis:run", 1, agent.search),
}
#: A question is a benchmark text behind a phrase that tells its intent; its tenant is a language.
PHRASES = ("", "Compare ", "risk of ", "Summarize ", "Extract ", "across documents ")
TENANTS = ("en", "de", "fr", "es")
ROLE_NAMES = ("ADMIN", "VIEWER", "ANALYST", "LEGAL_MANAGER", "VIEWER")


def _pick(values: tuple[str, ...], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(
    f"""WITH RECURSIVE qs AS (SELECT item_id AS id, {_pick(PHRASES, "item_id")} || text AS text, {_pick(TENANTS, "(item_id // 6)")} AS tenant, {_pick(ROLE_NAMES, "item_id")} AS role FROM benchmark),
    ro AS (SELECT *, {_pick(("qa", "compare", "risk", "summarize", "extract", "multi_document"), "id")} AS intent, CASE id % 6 WHEN 1 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS needed, id % 6 IN (0, 1, 5) OR role <> 'VIEWER' AS permitted FROM qs),
    kinds AS (SELECT unnest([false, true]) AS risky),
    d AS (SELECT risky, doc_id AS id, lang, coalesce(text, '') AS text FROM documents, kinds WHERE NOT risky OR contains(text, '{RISKY}')),
    w AS (SELECT risky, id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS term FROM d), p AS (SELECT risky, id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
    l AS (SELECT d.risky, d.id, coalesce(sum(tf), 0) AS len FROM d LEFT JOIN p ON p.id = d.id AND p.risky = d.risky GROUP BY ALL), st AS (SELECT risky, count(*) AS n, avg(len) AS mean FROM l GROUP BY 1), f AS (SELECT risky, term, count(*) AS df FROM p GROUP BY ALL),
    qt AS (SELECT DISTINCT id AS question, tenant, intent = 'risk' AS risky, unnest(string_split_regex(lower(text), '[ \\n]+')) AS term FROM ro WHERE permitted),
    sc AS (SELECT question, id, tenant, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN p USING (risky, term) JOIN f USING (risky, term) JOIN l USING (risky, id) JOIN st USING (risky) WHERE term <> '' GROUP BY ALL),
    ca AS (SELECT question, sc.id, row_number() OVER (PARTITION BY question ORDER BY score DESC, sc.id) AS place FROM sc JOIN documents ON doc_id = sc.id WHERE lang = tenant),
    ov AS MATERIALIZED (SELECT question, ca.id, place, round(len(list_intersect(list_distinct(string_split_regex(lower(q.text), '[ \\n]+')), list_distinct(string_split_regex(lower(d.text), '[ \\n]+')))) / len(list_distinct(string_split_regex(lower(q.text), '[ \\n]+'))), 6) AS overlap
      FROM ca JOIN ro q ON q.id = question JOIN documents d ON doc_id = ca.id WHERE place <= 18),
    s AS (SELECT id, needed, 0 AS rounds, CASE WHEN permitted THEN 'open' ELSE 'FORBIDDEN' END AS verdict, []::BIGINT[] AS citations FROM ro
      UNION ALL SELECT id, needed, rounds + 1, CASE WHEN len(c) >= needed THEN 'answered' WHEN rounds = 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'open' END, c FROM
        (SELECT s.id, s.needed, s.rounds, list_concat(s.citations, coalesce((SELECT list(ov.id) FROM ov WHERE question = s.id AND overlap >= 0.8 AND place > 6 * s.rounds AND place <= 6 * s.rounds + 6), [])) AS c FROM s WHERE verdict = 'open'))
    SELECT s.id, intent, rounds::BIGINT AS rounds, verdict, array_to_string(list_sort(citations), ',') AS citations FROM s JOIN ro USING (id) WHERE verdict <> 'open'"""
)
def agent_rounds(spark, sf_dir) -> DataFrame:
    """Every benchmark text as a question of a tenant and a role; documents are the chunks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tenant"), F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(
        i.alias("id"), F.concat(F.expr(_pick(PHRASES, "item_id")), "text").alias("text"), F.expr(_pick(TENANTS, "(item_id div 6)")).alias("tenant"), F.expr(_pick(ROLE_NAMES, "item_id")).alias("role")
    )
    found = agent.answer(asked, docs, agent.ToolRegistry(spark, TOOLS))
    return found.withColumn("citations", F.array_join(F.col("citations").cast("array<string>"), ","))
