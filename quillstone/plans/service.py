"""Queries of a service around the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.labels import STAGES
from quillstone.operators import service, text
from quillstone.plans.catalogue import query
from quillstone.plans.ingestion import JOBS
from quillstone.plans.retrieval import metric_sql, metrics
from quillstone.plans.tenancy import customers
from quillstone.sources.tables import table
from quillstone.streaming import jobs


@query("SELECT (SELECT count(*) FROM region) > 0 AS ok")
def ping(spark, sf_dir) -> DataFrame:
    """Whether the store answers with rows."""
    return table(spark, sf_dir, "region").agg((F.count("*") > 0).alias("ok"))


@query(
    """SELECT (SELECT coalesce(string_agg(c_custkey, ',' ORDER BY c_custkey), '') FROM (SELECT c_custkey FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 20 OFFSET 3)) AS items,
    (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS total, 3::BIGINT AS "offset", 20::BIGINT AS "limit" """
)
def page_envelope(spark, sf_dir) -> DataFrame:
    found = service.page_envelope(customers(spark, sf_dir), "c_custkey", offset=3, limit=20)
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


FILES = """(SELECT source, doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 11 = 0 THEN 'extension' WHEN doc_id % 13 = 0 THEN 'mime' WHEN n_chars = 0 THEN 'empty'
    WHEN n_chars * 4096 > 52428800 THEN 'too_big' WHEN doc_id % 17 = 0 THEN 'magic' END AS rejected FROM documents)"""


@query(
    f"""WITH f AS {FILES}, m AS (SELECT f.*, CASE WHEN rejected IS NULL AND doc_id <> min(doc_id) FILTER (rejected IS NULL) OVER (PARTITION BY source, sha256) THEN min(doc_id) FILTER (rejected IS NULL) OVER (PARTITION BY source, sha256) END AS duplicate_of FROM f)
    SELECT source, doc_id, unnest(CASE WHEN rejected IS NOT NULL THEN ['audit'] WHEN duplicate_of IS NOT NULL THEN ['version', 'job', 'audit'] ELSE ['document', 'version', 'job', 'audit'] END) AS kind, rejected, duplicate_of FROM m"""
)
def upload_sink(spark, sf_dir) -> DataFrame:
    """Stand-in: a document is a file; name, MIME type and magic bytes follow its id, 4096 bytes a character."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text", "n_chars")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 0, ".exe").otherwise(".PDF"))
    mime = F.when(F.col("doc_id") % 13 == 0, "text/html").otherwise("application/pdf")
    magic = F.when(F.col("doc_id") % 17 == 0, "MZ").otherwise("%PDF")
    files = docs.select("source", "doc_id", F.sha2("text", 256).alias("sha256"), service.upload_reason(name, mime, magic, F.col("n_chars") * 4096).alias("rejected"))
    return service.upload_rows(files, "source", "doc_id")


@query("SELECT user_id, count(*) AS n_steps, round(sum(value), 4) AS cost, count(*) > 8 AS over_iterations, round(sum(value), 4) > 500 AS over_budget, max(ts) > min(ts) + INTERVAL 20 DAY AS over_time FROM events GROUP BY 1")
def tool_guardrail(spark, sf_dir) -> DataFrame:
    """A user is an agent run, an event a step, its value the cost."""
    return service.over_limits(table(spark, sf_dir, "events"), "user_id", "value", 8, 500.0, 20 * 86_400)


ANSWERS = """(SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"k": "x"}' WHEN 2 THEN '{"k": 1' ELSE '{"other": 1}' END AS answer FROM events)"""


@query(f"SELECT event_id, CASE WHEN NOT json_valid(answer) THEN 'malformed' WHEN TRY_CAST(json_extract(answer, '$.k') AS INT) IS NULL THEN 'missing' ELSE 'ok' END AS verdict FROM {ANSWERS}")
def output_guardrail(spark, sf_dir) -> DataFrame:
    """Answers against the schema k int; three of four rows are made to break it."""
    k = F.col("event_id") % 4
    answer = F.when(k == 0, F.col("props")).when(k == 1, '{"k": "x"}').when(k == 2, '{"k": 1').otherwise('{"other": 1}')
    return table(spark, sf_dir, "events").select("event_id", service.schema_check(answer, "k int").alias("verdict"))


SAID = "(SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, 0, 'See **clause 4** [2] and [11], **not** [x] * [2].')"


@query(
    f"""SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '\\[([0-9]{{1,9}})\\]', 1), ',') AS citations, array_to_string(regexp_extract_all(text, '[*][*]([^*]+)[*][*]', 1), ',') AS bold,
    length(regexp_replace(regexp_replace(text, '\\[[0-9]{{1,9}}\\]', '', 'g'), '[*][*]([^*]+)[*][*]', '\\1', 'g')) AS n_plain FROM {SAID}"""
)
def answer_parts(spark, sf_dir) -> DataFrame:
    """No turn has marks, so one is planted."""
    planted = spark.createDataFrame([(-1, 0, "See **clause 4** [2] and [11], **not** [x] * [2].")], "conv_id bigint, turn bigint, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").union(planted).select("conv_id", "turn", service.answer_parts(F.col("text")).alias("a"))
    return rows.select("conv_id", "turn", F.array_join(F.col("a.citations").cast("array<string>"), ",").alias("citations"), F.array_join("a.bold", ",").alias("bold"), F.length("a.plain").cast("long").alias("n_plain"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b', 1), ',') AS dates, length(text) > 2000 AS is_long FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'Signed 2024-01-31, ends 2026-12-01, not 12024-01-31.')")
def structured_extraction(spark, sf_dir) -> DataFrame:
    """Key dates of each document; one with dates is planted."""
    planted = spark.createDataFrame([(-1, "Signed 2024-01-31, ends 2026-12-01, not 12024-01-31.")], "doc_id bigint, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(planted)
    return docs.select("doc_id", F.array_join(text.key_dates(F.col("text")), ",").alias("dates"), (F.length("text") > 2000).alias("is_long"))


RUN_METRICS = ["recall", "precision", "ndcg"]


def _runs_sql() -> str:
    runs = " UNION ALL ".join(f"SELECT * FROM ({metric_sql(k)} SELECT 'top{k}' AS config, CASE WHEN query % 200 = 0 THEN 'even' ELSE 'odd' END AS dataset, {', '.join(RUN_METRICS)} FROM m)" for k in (5, 10))
    each = " UNION ALL ".join(f"SELECT config, dataset, count(*) AS n_samples, '{m}' AS metric, round(avg({m}), 4) AS mean FROM r GROUP BY 1, 2" for m in RUN_METRICS)
    return f"WITH r AS ({runs}) {each}"


@query(_runs_sql())
def evaluation_runs(spark, sf_dir) -> DataFrame:
    """Two configurations (5 and 10 results) over two data sets (queries by parity of their hundreds)."""
    dataset = F.when(F.col("query") % 200 == 0, "even").otherwise("odd")
    runs = [metrics(spark, sf_dir, k).select(F.lit(f"top{k}").alias("config"), dataset.alias("dataset"), *RUN_METRICS) for k in (5, 10)]
    return service.evaluation_runs(runs[0].union(runs[1]), RUN_METRICS).select("config", "dataset", "n_samples", F.explode("metrics").alias("metric", "mean"))


@query(f"SELECT job, status, current_stage AS stage, progress, attempts FROM {JOBS}")
def job_stream_state(spark, sf_dir) -> DataFrame:
    """The streaming state machine, run over the stage log that is there."""
    events = jobs.event_stream(spark, sf_dir)
    stage = F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 5).cast("int"))
    phase = F.expr("CASE WHEN event_id % 23 = 0 THEN 'fail' WHEN event_id % 3 = 0 THEN 'start' ELSE 'end' END")
    steps = events.select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("seq"), stage.alias("stage"), phase.alias("phase"))
    return jobs.latest_states(jobs.job_stream(steps)).select("job", "status", "stage", "progress", F.col("attempts").cast("long").alias("attempts"))


@query("SELECT doc_id, toxic AS risk FROM documents JOIN labels USING (doc_id) WHERE toxic <> 0")
def clauses_with_risk(spark, sf_dir) -> DataFrame:
    """Clauses whose risk is neither missing nor zero."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id").filter("toxic IS NOT NULL AND toxic <> 0").select("doc_id", F.col("toxic").alias("risk"))


@query("SELECT event_id, coalesce(c_custkey, (SELECT min(c_custkey) FROM customer)) AS found FROM (SELECT event_id, user_id * 7 AS asked FROM events) LEFT JOIN customer ON c_custkey = asked")
def find_or_first(spark, sf_dir) -> DataFrame:
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 7).alias("asked"))
    return service.found_or_first(asked, "asked", table(spark, sf_dir, "customer"), "c_custkey").select("event_id", "found")


@query(
    """SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'default_secret' END, CASE WHEN s_nationkey % 2 = 0 AND s_nationkey % 5 < 2 THEN 'bucket' END, CASE WHEN s_nationkey % 7 = 0 THEN 'wildcard_origin' END],
    lambda x: x IS NOT NULL AND s_nationkey % 4 <> 0), ',') AS errors FROM supplier"""
)
def settings_guard(spark, sf_dir) -> DataFrame:
    """Stand-in: a supplier is a deployment, its keys tell its settings."""
    n = F.col("s_nationkey")
    environment = F.when(n % 4 == 0, "development").otherwise("production")
    secret = F.when(F.col("s_suppkey") % 3 == 0, "change-me").otherwise("s")
    bucket = F.when(n % 5 == 0, None).when(n % 5 == 1, "").otherwise("b")
    origins = F.when(n % 7 == 0, "https://a, *").otherwise("https://a,https://b")
    errors = service.settings_errors(environment, secret, F.when(n % 2 == 0, "s3").otherwise("local"), bucket, origins)
    return table(spark, sf_dir, "supplier").select("s_suppkey", errors.alias("errors"))


@query("SELECT o_custkey, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 2, 4), ',') AS shown FROM orders GROUP BY 1")
def list_slices(spark, sf_dir) -> DataFrame:
    """Of a customer's first orders the second to the fourth."""
    first = F.slice(F.array_sort(F.collect_list("o_orderkey")), 2, 3)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(first.cast("array<string>"), ",").alias("shown"))


@query("SELECT o_orderkey, coalesce(c_name, 'A') AS left_label, coalesce(c_mktsegment, 'B') AS right_label FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 20")
def version_labels(spark, sf_dir) -> DataFrame:
    known = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select("c_custkey", "c_name", "c_mktsegment")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.lit("A")).alias("left_label"), F.coalesce("c_mktsegment", F.lit("B")).alias("right_label"))


@query("SELECT -1 AS n_nationkey, 'NEW' AS n_name, 0 AS place UNION ALL SELECT n_nationkey, n_name, 1 FROM nation")
def prepend_row(spark, sf_dir) -> DataFrame:
    new = spark.createDataFrame([(-1, "NEW", 0)], "n_nationkey int, n_name string, place int")
    return new.unionByName(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(1).alias("place")))


PAGES = "(SELECT page_id, html FROM pages UNION ALL SELECT -1, '<p>x</p><img alt=\"a chart\" src=\"c.png\"><table><tr><td>1</td></tr></table>')"


@query(
    f"""SELECT page_id, 'text' AS chunk_type, 'page' AS caption FROM {PAGES} UNION ALL SELECT page_id, 'image', 'image ' || unnest(regexp_extract_all(html, '<img[^>]*src="([^"]*)"', 1)) FROM {PAGES}
    UNION ALL SELECT page_id, 'table', 'table of ' || len(regexp_extract_all(x, '<tr')) || ' rows' FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<table[^>]*>(.*?)</table>', 1)) AS x FROM {PAGES})"""
)
def caption_chunks(spark, sf_dir) -> DataFrame:
    """Images and tables as chunks of their page, so that they can be found; one page with both is planted."""
    planted = spark.createDataFrame([(-1, '<p>x</p><img alt="a chart" src="c.png"><table><tr><td>1</td></tr></table>')], "page_id bigint, html string")
    pages = table(spark, sf_dir, "pages").select("page_id", "html").union(planted)
    images = pages.select("page_id", F.explode(text.image_sources(F.col("html"))).alias("src")).select("page_id", F.lit("image").alias("chunk_type"), F.concat(F.lit("image "), "src").alias("caption"))
    tables = pages.select("page_id", F.explode(text.html_tables(F.col("html"))).alias("t")).select("page_id", F.lit("table").alias("chunk_type"), F.concat(F.lit("table of "), F.size("t").cast("string"), F.lit(" rows")).alias("caption"))
    return pages.select("page_id", F.lit("text").alias("chunk_type"), F.lit("page").alias("caption")).unionByName(images).unionByName(tables)


@query(
    """WITH e AS (SELECT event_id, value, floor(abs(value) * 1048576)::HUGEINT AS high, floor((abs(value) * 1048576 - floor(abs(value) * 1048576)) * 1099511627776)::HUGEINT AS low FROM events),
    p AS (SELECT event_id, value, (high * 1099511627776 + low) * 100 AS x FROM e), q AS (SELECT event_id, value, x // 1152921504606846976 AS w, x % 1152921504606846976 AS r FROM p)
    SELECT event_id, sign(value) * (w + CASE WHEN r * 2 > 1152921504606846976 OR (r * 2 = 1152921504606846976 AND w % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100 AS ms FROM q"""
)
def round_half_even(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", service.half_even(F.col("value")).alias("ms"))


@query(f"SELECT stage, event_type AS prompt_version, count(*) AS n_calls, round(sum(value), 4) AS tokens, round(sum(value) * 0.002, 6) AS cost, round(quantile_cont(value, 0.95), 6) AS p95 FROM (SELECT *, {'[' + ','.join(repr(s) for s in STAGES) + ']'}[CAST(1 + event_id % 5 AS INT)] AS stage FROM events) GROUP BY 1, 2")
def llm_usage_by_stage(spark, sf_dir) -> DataFrame:
    """Tokens, cost and latency per stage and prompt version (an event type here)."""
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 5).cast("int")).alias("stage"))
    return rows.groupBy("stage", F.col("event_type").alias("prompt_version")).agg(
        F.count("*").alias("n_calls"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.sum("value") * 0.002, 6).alias("cost"), F.round(F.percentile("value", 0.95), 6).alias("p95")
    )
