"""Portfolio queries; an order is a document, its line items are its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import formatting
from quillstone.functions.labels import next_status, severity_of_order, status_label, status_of_order, step_index
from quillstone.operators import portfolio
from quillstone.plans.catalogue import query
from quillstone.sources.tables import table

NOW = "1998-06-01 12:00:00"
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END"
SEVERITY = "CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'medium' ELSE 'low' END"
STATE = "CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'reviewing' ELSE 'accepted' END"
DAYS = "CAST(ceil(date_diff('millisecond', TIMESTAMP '1998-06-01 12:00:00', o_orderdate) / 86400000.0) AS BIGINT)"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def orders(spark, sf_dir) -> DataFrame:
    """Orders as documents: status, severity, state, days_until."""
    o = table(spark, sf_dir, "orders")
    return o.withColumns(
        {
            "status": status_of_order(F.col("o_orderstatus")),
            "severity": severity_of_order(F.col("o_orderpriority")),
            "state": F.expr(STATE),
            "days_until": formatting.days_until(F.col("o_orderdate"), now()),
        }
    )


@query(f"SELECT count(*) AS n_all, count(*) FILTER (s NOT IN ('COMPLETED', 'FAILED')) AS n_processing, count(*) FILTER (s = 'COMPLETED') AS n_ready, count(*) FILTER (s = 'FAILED') AS n_failed FROM (SELECT {STATUS} AS s FROM orders)")
def status_tabs(spark, sf_dir) -> DataFrame:
    return portfolio.status_counts(orders(spark, sf_dir))


@query(
    f"""SELECT s AS status, CASE s WHEN 'COMPLETED' THEN 'Ready' WHEN 'PROCESSING' THEN 'Parsing' ELSE 'Failed' END AS label,
    CASE s WHEN 'PROCESSING' THEN 'OCR_PROCESSING' END AS next_status, CASE s WHEN 'COMPLETED' THEN 6 ELSE 1 END AS step, count(*) AS n
    FROM (SELECT {STATUS} AS s FROM orders) GROUP BY s"""
)
def status_labels(spark, sf_dir) -> DataFrame:
    s = F.col("status")
    counted = orders(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return counted.select("status", status_label(s).alias("label"), next_status(s).alias("next_status"), step_index(s, F.lit(None)).alias("step"), "n")


@query(f"SELECT bool_or({STATUS} = 'PROCESSING') AS in_flight FROM orders")
def in_flight_exists(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).agg(F.coalesce(F.bool_or(F.col("status") == "PROCESSING"), F.lit(False)).alias("in_flight"))


@query(
    f"""WITH o AS (SELECT o_orderkey, {STATUS} AS s FROM orders) SELECT 'all' AS tab, o_orderkey FROM o UNION ALL SELECT 'processing', o_orderkey FROM o WHERE s NOT IN ('COMPLETED', 'FAILED')
    UNION ALL SELECT 'ready', o_orderkey FROM o WHERE s = 'COMPLETED' UNION ALL SELECT 'failed', o_orderkey FROM o WHERE s = 'FAILED'"""
)
def tab_documents(spark, sf_dir) -> DataFrame:
    """The documents behind each of the four tabs, in one scan."""
    return orders(spark, sf_dir).select(F.explode(portfolio.tabs_of(F.col("status"))).alias("tab"), "o_orderkey")


@query(f"SELECT o_orderkey, {STATUS} AS status FROM orders WHERE {STATUS} = 'FAILED'")
def tab_failed(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).filter("status = 'FAILED'").select("o_orderkey", "status")


@query(
    f"""WITH p AS (SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY 1), o AS (SELECT *, {STATUS} AS s, {SEVERITY} AS v, {STATE} AS t, {DAYS} AS d FROM orders)
    SELECT count(*) FILTER (s = 'COMPLETED') AS indexed, CAST(coalesce(sum(pages) FILTER (s = 'COMPLETED'), 0) AS BIGINT) AS pages, count(*) FILTER (s = 'PROCESSING') AS processing,
    count(*) FILTER (v = 'high' AND t <> 'accepted') AS open_high, count(*) AS findings, count(*) FILTER (d BETWEEN 0 AND 90) AS deadlines FROM o LEFT JOIN p ON o_orderkey = l_orderkey"""
)
def kpi_row(spark, sf_dir) -> DataFrame:
    docs = orders(spark, sf_dir)
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pages"))
    return portfolio.kpi_row(docs.join(pages, docs.o_orderkey == pages.l_orderkey, "left"), docs, docs)


EXPOSURE = f"""WITH c AS (SELECT o_custkey AS doc, count(*) FILTER (v = 'high') AS high, count(*) FILTER (v = 'medium') AS medium, count(*) FILTER (v = 'low') AS low,
    count(*) AS total, min(o_orderkey) AS first_pos FROM (SELECT *, {SEVERITY} AS v FROM orders) GROUP BY 1)
    SELECT *, 3 * high + medium AS weight, round(100 * total / greatest((SELECT max(total) FROM c), 1)::DOUBLE, 6) AS width FROM c"""


@query(EXPOSURE)
def risk_exposure(spark, sf_dir) -> DataFrame:
    return portfolio.exposure(orders(spark, sf_dir).selectExpr("o_custkey AS doc", "o_orderkey AS pos", "severity"))


@query(f"SELECT * FROM ({EXPOSURE}) ORDER BY weight DESC, first_pos LIMIT 10")
def risk_exposure_top(spark, sf_dir) -> DataFrame:
    return risk_exposure(spark, sf_dir).orderBy(F.desc("weight"), "first_pos").limit(10)


@query(f"SELECT count(*) AS n_all, count(*) FILTER (v = 'high') AS n_high, count(*) FILTER (v = 'medium') AS n_medium, count(*) FILTER (v = 'low') AS n_low FROM (SELECT {SEVERITY} AS v FROM orders)")
def risk_tiles(spark, sf_dir) -> DataFrame:
    return portfolio.severity_counts(orders(spark, sf_dir))


@query(f"SELECT o_orderkey, {STATE} AS state FROM orders WHERE {SEVERITY} = 'high' AND {STATE} <> 'accepted'")
def open_high_risk(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).filter("severity = 'high' AND state <> 'accepted'").select("o_orderkey", "state")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def recent_five(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey", "o_orderdate")


@query(f"SELECT o_orderkey, {DAYS} AS days_until FROM orders WHERE {DAYS} BETWEEN 0 AND 90")
def deadlines_90d(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).filter("days_until BETWEEN 0 AND 90").select("o_orderkey", "days_until")


@query(f"SELECT {DAYS} AS days, count(*) AS n FROM orders GROUP BY 1")
def days_until(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).groupBy(F.col("days_until").alias("days")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN {DAYS} <= 0 THEN 'Today' ELSE 'in ' || {DAYS} || 'd' END AS label, {DAYS} <= 14 AS urgent, count(*) AS n FROM orders GROUP BY 1, 2")
def deadline_label(spark, sf_dir) -> DataFrame:
    d = F.col("days_until")
    return orders(spark, sf_dir).groupBy(formatting.deadline_label(d).alias("label"), (d <= 14).alias("urgent")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 30 DAY AS DATE) AS notice_by FROM orders WHERE {DAYS} > 30")
def notice_windows(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).filter("days_until > 30").select("o_orderkey", F.date_sub(F.col("o_orderdate").cast("date"), 30).alias("notice_by"))


@query(
    """WITH e AS (SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-15 00:00:00', ts) / 1e6 AS s FROM events)
    SELECT event_id, CASE WHEN abs(s) < 60 THEN 'second' WHEN abs(s) < 3600 THEN 'minute' WHEN abs(s) < 86400 THEN 'hour' ELSE 'day' END AS unit,
    CAST(floor(s / CASE WHEN abs(s) < 60 THEN 1 WHEN abs(s) < 3600 THEN 60 WHEN abs(s) < 86400 THEN 3600 ELSE 86400 END + 0.5) AS BIGINT) AS value FROM e"""
)
def relative_time(spark, sf_dir) -> DataFrame:
    at = formatting.relative_time(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", at.alias("t")).select("event_id", "t.unit", "t.value")


@query(
    """SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 10240 THEN ((b * 10 + 512) // 1024) // 10 || '.' || ((b * 10 + 512) // 1024) % 10 || ' KB'
    WHEN b < 1048576 THEN (b + 512) // 1024 || ' KB' WHEN b < 10485760 THEN ((b * 10 + 524288) // 1048576) // 10 || '.' || ((b * 10 + 524288) // 1048576) % 10 || ' MB'
    ELSE (b + 524288) // 1048576 || ' MB' END AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 900) AS b FROM documents)"""
)
def format_bytes(spark, sf_dir) -> DataFrame:
    size = F.col("n_chars") * (1 + F.col("doc_id") % 900)
    return table(spark, sf_dir, "documents").select("doc_id", formatting.format_bytes(size).alias("size"))


@query("SELECT strftime(o_orderdate, '%-d %b %Y') AS day, count(*) AS n FROM orders GROUP BY 1")
def format_date(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(formatting.format_date(F.col("o_orderdate")).alias("day")).agg(F.count("*").alias("n"))


@query(
    """SELECT item_id, CASE WHEN length(trim(q)) < 3 THEN 'too_short' WHEN length(trim(q)) > 2000 THEN 'too_long' END AS problem
    FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN ' ' || substr(text, 1, 2) || ' ' ELSE repeat(text, 9) END AS q FROM benchmark)"""
)
def question_validation(spark, sf_dir) -> DataFrame:
    q = F.expr("CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN ' ' || substr(text, 1, 2) || ' ' ELSE repeat(text, 9) END")
    return table(spark, sf_dir, "benchmark").select("item_id", formatting.question_problem(q).alias("problem"))


@query(
    """SELECT doc_id, CASE WHEN NOT ends_with(lower(name), '.pdf') OR (mime <> '' AND mime <> 'application/pdf') THEN 'type' WHEN size = 0 THEN 'empty' WHEN size > 5 * 1024 * 1024 THEN 'too_big' END AS problem
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'a.docx' ELSE 'A.PDF' END AS name, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'application/pdf' ELSE 'text/html' END AS mime, n_chars * (doc_id % 5) * 1000 AS size FROM documents)"""
)
def file_validation(spark, sf_dir) -> DataFrame:
    files = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 7 = 0 THEN 'a.docx' ELSE 'A.PDF' END AS name", "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'application/pdf' ELSE 'text/html' END AS mime", "n_chars * (doc_id % 5) * 1000 AS size"
    )
    return files.select("doc_id", formatting.file_problem(F.col("name"), F.col("mime"), F.col("size"), 5).alias("problem"))


@query(
    """SELECT doc_id, len(l) AS n_origins, list_aggregate(l, 'string_agg', '|') AS origins FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN list_filter(list_transform(string_split(lang || ' , ,' || source, ','), lambda x: trim(x)), lambda x: x <> '')
    ELSE [lang, source] END AS l FROM documents)"""
)
def origin_list(spark, sf_dir) -> DataFrame:
    text = F.expr("CASE WHEN doc_id % 2 = 0 THEN lang || ' , ,' || source ELSE to_json(array(lang, source)) END")
    rows = table(spark, sf_dir, "documents").select("doc_id", formatting.origin_list(text).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_origins"), F.array_join("l", "|").alias("origins"))


@query("SELECT l_orderkey AS doc, l_shipmode_like AS section, n FROM (SELECT l_orderkey, l_returnflag AS l_shipmode_like, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def section_outline(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS pos", "l_returnflag AS section", "l_partkey AS clause")
    return portfolio.ordered_sections(items).select("doc", "section", F.size("clauses").cast("long").alias("n"))
