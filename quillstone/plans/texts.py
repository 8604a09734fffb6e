"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import guardrails
from quillstone.operators import grids, rulescan, text
from quillstone.plans.catalogue import query
from quillstone.sources.tables import table


def _rule_sql() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, '{s}' AS severity, regexp_extract(text, '{p}', 0) AS evidence FROM documents WHERE regexp_matches(text, '{p}')" for n, s, p in text.RULES)


@query(_rule_sql())
def risk_rules(spark, sf_dir) -> DataFrame:
    return text.risk_findings(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, 'Licensed under the [A-Z][A-Za-z]+')")
def missing_clause(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(~F.col("text").rlike(text.RULES[0][2])).select("doc_id", "lang")


CHUNKS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  h AS (SELECT *, CASE WHEN regexp_matches(line, '^[0-9]+([.][0-9]+)* +[A-Z]') THEN regexp_extract(line, '^([0-9]+(?:[.][0-9]+)*)', 1) END AS heading FROM l),
  c AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_no FROM h)"""


@query(f"{CHUNKS} SELECT doc_id, chunk_no, max(heading) AS heading, count(*) AS n_lines, length(string_agg(line, chr(10) ORDER BY pos)) AS n_chars FROM c GROUP BY 1, 2")
def clause_chunks(spark, sf_dir) -> DataFrame:
    chunks = text.clause_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return chunks.select("doc_id", "chunk_no", "heading", "n_lines", F.length("text").cast("long").alias("n_chars"))


PLANTED = "1 Term\nTwo years.\n1.1 Renewal\nBy notice.\n2 Fees\nNet 30."


@query(
    f"""{CHUNKS.replace("FROM documents", "FROM d").replace("WITH l", "WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '" + PLANTED.replace(chr(10), "' || chr(10) || '") + "'), l")},
    k AS (SELECT doc_id, chunk_no, max(heading) AS heading, string_agg(line, chr(10) ORDER BY pos) AS text FROM c GROUP BY 1, 2),
    p AS (SELECT *, CASE WHEN contains(heading, '.') THEN regexp_replace(heading, '[.][0-9]+$', '') END AS parent FROM k)
    SELECT p.doc_id, p.chunk_no, p.heading, p.parent, u.text AS parent_text FROM p LEFT JOIN p u ON u.doc_id = p.doc_id AND u.heading = p.parent"""
)
def chunk_parent_child(spark, sf_dir) -> DataFrame:
    """Every document's chunks; no document has numbered headings, so one is planted beside them."""
    planted = spark.createDataFrame([(-1, PLANTED)], "doc_id bigint, text string")
    chunks = text.clause_chunks(table(spark, sf_dir, "documents").select("doc_id", "text").union(planted), "doc_id")
    return text.with_parent_text(chunks, "doc_id").select("doc_id", "chunk_no", "heading", "parent", "parent_text")


@query(
    """WITH l AS (SELECT DISTINCT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY 1)
    SELECT source, line, count(*) AS n, any_value(n_pages) AS n_pages FROM l JOIN n USING (source) WHERE line <> '' GROUP BY 1, 2 HAVING count(*) > 0.02 * any_value(n_pages)"""
)
def header_footer_lines(spark, sf_dir) -> DataFrame:
    return text.running_lines(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", 0.02).select("source", "line", "n", "n_pages")


PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"SELECT page_id, {PLAIN} AS text FROM pages")
def html_to_text(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, length({PLAIN}) < 400 AS needs_ocr FROM pages")
def scanned_pages(spark, sf_dir) -> DataFrame:
    """Pages with hardly a text layer: under 400 characters, as no page here has none."""
    return table(spark, sf_dir, "pages").select("page_id", (F.length(text.plain_text(F.col("html"))) < 400).alias("needs_ocr"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>')) AS n_tables, len(regexp_extract_all(html, '(?is)<img[^>]*?src=[\"'']([^\"'']*)')) AS n_images FROM pages")
def page_tables(spark, sf_dir) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.html_tables(html)).cast("long").alias("n_tables"), F.size(text.image_sources(html)).cast("long").alias("n_images"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, count(*) AS n FROM conversations GROUP BY 1")
def conversation_history(spark, sf_dir) -> DataFrame:
    ordered = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"), F.count("*").alias("n"))
    return ordered.select("conv_id", F.array_join(F.transform("x", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("history"), "n")


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system, count(*) FILTER (role <> 'system') AS n_other FROM conversations GROUP BY 1")
def system_prompt_concat(spark, sf_dir) -> DataFrame:
    """System messages joined in order, apart from the others."""
    own = F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text"))))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(own.alias("x"), F.count_if(F.col("role") != "system").alias("n_other"))
    return grouped.select("conv_id", F.array_join(F.transform("x", lambda m: m["text"]), "\n\n").alias("system"), "n_other")


@query(
    """WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, source, len(l) AS n, unnest(l) AS line, unnest(range(len(l))) AS i FROM l),
    m AS (SELECT *, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS pattern FROM x),
    e AS (SELECT DISTINCT doc_id, source, 'top' AS place, pattern FROM m WHERE i < 3 AND pattern <> '' UNION SELECT DISTINCT doc_id, source, 'bottom', pattern FROM m WHERE i >= n - 3 AND pattern <> ''),
    g AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY 1), r AS (SELECT source, place, pattern FROM e JOIN g USING (source) GROUP BY ALL HAVING count(*) > 0.02 * any_value(n_pages) AND count(*) >= 2),
    k AS (SELECT *, (i < 3 AND (source, 'top', pattern) IN (SELECT (source, place, pattern) FROM r)) OR (i >= n - 3 AND (source, 'bottom', pattern) IN (SELECT (source, place, pattern) FROM r)) AS runs FROM m)
    SELECT doc_id, count(*) FILTER (runs) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT runs), '')) AS sha256 FROM k GROUP BY 1"""
)
def layout_cleanup(spark, sf_dir) -> DataFrame:
    """Documents without the lines that run at the head or foot of a source's texts."""
    cleaned = text.without_running_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", 0.02)
    return cleaned.select("doc_id", "n_dropped", F.sha2("cleaned", 256).alias("sha256"))


#: Every injection and risk rule with literals that each match holds one of.
LITERALS = {
    "override_instructions": ("instruction", "prompt", "rule"), "reveal_system": ("system prompt", "hidden instruction", "developer message"),
    "role_hijack": ("you are now", "act as", "new instruction"), "tool_abuse": ("tool", "function", "command", "shell"),
    "exfiltration": ("http://", "https://", "api key", "credential", "password"), "delimiter_forgery": ("system", "untrusted_document", "instruction"),
    "license_notice": ("licensed under the ",), "contact_address": ("@",), "credential": ("password", "secret", "token", "api_key"), "access_key": ("akia",), "shouting": ("!!",),
    "symbol_noise": ("***", "%%%", "###"), "table_row": (" | ",),
}
ALL_RULES = tuple(rulescan.Rule(n, "high", p, LITERALS[n], ignore_case=True) for n, p in guardrails.INJECTION_RULES) + tuple(rulescan.Rule(n, s, p, LITERALS[n]) for n, s, p in text.RULES)


def _scan_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, '{r.name}' AS rule, '{r.severity}' AS severity, regexp_extract(text, '{'(?i)' * r.ignore_case}{r.pattern}', 0) AS evidence FROM documents WHERE regexp_matches(text, '{'(?i)' * r.ignore_case}{r.pattern}')" for r in ALL_RULES
    )


@query(_scan_sql())
def rule_scan(spark, sf_dir) -> DataFrame:
    """All rules in one pass over each document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return rulescan.scan_rules(docs, ALL_RULES).withColumnRenamed("id", "doc_id")


@query(
    """WITH o AS (SELECT o_custkey AS c, o_orderstatus AS s, o_orderkey AS k, o_orderpriority AS p FROM orders),
    g AS (SELECT c, string_agg('| ' || s || ' | ' || k || ' | ' || p || ' |', chr(10) ORDER BY s, k) AS body, count(*) AS n FROM o GROUP BY 1)
    SELECT c AS page_id, 0 AS table_no, NULL::INT AS inside, (n + 1)::INT AS n_rows, 3 AS n_cols, '| status | order | order |' || chr(10) || '| --- | --- | --- |' || chr(10) || body AS markdown FROM g
    UNION ALL SELECT c, 1, 0, 1, 1, '| ' || n || ' |' || chr(10) || '| --- |' FROM g"""
)
def table_grids(spark, sf_dir) -> DataFrame:
    """Tables of the pages, which have none, and of a page for each customer: its orders with the
    status spanning rows, a heading spanning columns and a table within a cell."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    cells = F.transform("x", lambda o: F.concat(F.lit("<td>"), o["o_orderkey"].cast("string"), F.lit("</td><td>"), o["o_orderpriority"], F.lit("</td>")))
    rows = F.concat(F.lit("<tr><td rowspan="), F.size("x").cast("string"), F.lit(">"), "o_orderstatus", F.lit("</td>"), F.array_join(cells, "</tr><tr>"), F.lit("</tr>"))
    by_customer = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", rows.alias("html")))), lambda r: r["html"]), "").alias("body"), F.sum(F.size("x")).alias("n"))
    head = F.concat(F.lit("<table><tr><th>status<table><tr><td>"), F.col("n").cast("string"), F.lit("</table></th><th colspan='2'>order</th></tr>"))
    derived = by_customer.select(F.col("o_custkey").alias("page_id"), F.concat(head, "body", F.lit("</table>")).alias("html"))
    return grids.table_grids(table(spark, sf_dir, "pages").select("page_id", "html").unionByName(derived)).drop("cells")


FACT_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in text.CLAUSE_TYPES)
SIGNED = "Signed 2024-01-31 for USD 1,200.00 or $5. Either party may terminate.\nFees are net 30; a@b.example."


@query(
    f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '\\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\b', 1), ',') AS dates, array_to_string(regexp_extract_all(text, '{text.AMOUNT}'), ';') AS amounts,
    array_to_string(list_filter([{FACT_SQL}], lambda x: x IS NOT NULL), ',') AS clause_types, trim(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\pL'))[1]) AS summary
    FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '{SIGNED.replace(chr(10), "' || chr(10) || '")}')"""
)
def contract_facts(spark, sf_dir) -> DataFrame:
    """Dates, amounts, clause types and summary of every document; one with all of them is planted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, SIGNED)], "doc_id bigint, text string"))
    facts = docs.select("doc_id", text.contract_facts(F.col("text")).alias("f"))
    return facts.select("doc_id", F.array_join("f.dates", ",").alias("dates"), F.array_join("f.amounts", ";").alias("amounts"), F.array_join("f.clause_types", ",").alias("clause_types"), "f.summary")


@query(
    f"""SELECT page_id, CASE WHEN length({PLAIN}) < 20 AND regexp_matches(html, '(?i)<img[ >]') THEN 'ocr' WHEN regexp_matches(html, '(?i)<table[ >]') THEN 'table' WHEN regexp_matches(html, '(?i)<(aside|frameset|iframe|math|svg)[ >]|column-count') THEN 'complex' ELSE 'fast' END AS route FROM pages"""
)
def page_routes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.parse_route(F.col("html")).alias("route"))
