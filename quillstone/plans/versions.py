"""Versions: an order is a version of its customer's document and the job that made it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.labels import status_of_order
from quillstone.operators import versions as v
from quillstone.plans.catalogue import query
from quillstone.plans.portfolio import STATUS
from quillstone.sources.tables import table

NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number, {STATUS} AS status FROM orders)"


def order_versions(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("status", status_of_order(F.col("o_orderstatus")))
    return v.numbered(o, "o_custkey", "o_orderdate", "o_orderkey")


@query(
    """SELECT e.event_id, CASE WHEN o.o_orderkey IS NULL THEN 'missing' ELSE 'found' END AS result, c.c_name, n.n_name FROM events e LEFT JOIN orders o ON o.o_orderkey = e.user_id * 3
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""
)
def job_version_document(spark, sf_dir) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 3).alias("version"))
    found = jobs.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("version") == F.col("o_orderkey"), "left")
    found = found.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    found = found.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return found.select("event_id", F.when(F.col("o_orderkey").isNull(), "missing").otherwise("found").alias("result"), "c_name", "n_name")


@query(
    f"""SELECT o_custkey, o_orderkey, version_number, version_number = max(version_number) OVER (PARTITION BY o_custkey) AS is_current,
    lag(version_number) OVER (PARTITION BY o_custkey ORDER BY version_number) AS previous FROM {NUMBERED}"""
)
def version_lineage(spark, sf_dir) -> DataFrame:
    return v.lineage(order_versions(spark, sf_dir), "o_custkey").select("o_custkey", "o_orderkey", "version_number", "is_current", "previous")


@query(f"SELECT o_custkey, max_by(o_orderkey, version_number) AS current_version, max(version_number) AS version_number FROM {NUMBERED} WHERE status = 'COMPLETED' GROUP BY 1")
def current_version(spark, sf_dir) -> DataFrame:
    done = order_versions(spark, sf_dir).filter("status = 'COMPLETED'")
    return done.groupBy("o_custkey").agg(F.max_by("o_orderkey", "version_number").alias("current_version"), F.max("version_number").alias("version_number"))


@query("SELECT o_custkey, count(*) AS n_versions FROM orders GROUP BY 1 HAVING count(*) > 1")
def multi_version_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_versions")).filter("n_versions > 1")


@query(
    """SELECT c_custkey, list_aggregate(list(o_orderkey ORDER BY o_orderdate, o_orderkey), 'string_agg', ',') AS versions FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def document_versions(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(own, F.col("c_custkey") == F.col("o_custkey"))
    ordered = joined.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("x"))
    return ordered.select("c_custkey", F.array_join(F.transform("x", lambda s: s["o_orderkey"].cast("string")), ",").alias("versions"))


@query(
    """SELECT n_name, c_mktsegment, count(DISTINCT c_custkey) AS n_documents, count(o_orderkey) AS n_versions FROM nation JOIN customer ON c_nationkey = n_nationkey
    LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (n_name, c_mktsegment)"""
)
def org_rollup(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # A customer is one row here, so a plain count is the distinct count.
    return docs.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_versions"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def cascade_delete(spark, sf_dir) -> DataFrame:
    gone = table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    customers = table(spark, sf_dir, "customer")
    gone_customers = customers.join(gone, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return v.cascade_delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone_customers, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) ON o_custkey = c_custkey")
def set_null(spark, sf_dir) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_nationkey = 7")
    return v.set_null(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


COMPARED = f"""WITH n AS MATERIALIZED (SELECT o_custkey, o_orderkey, version_number = last AS is_last FROM (SELECT *, max(version_number) OVER (PARTITION BY o_custkey) AS last FROM {NUMBERED}) WHERE last > 1 AND version_number >= last - 1),
    c AS MATERIALIZED (SELECT l_orderkey, l_returnflag || l_linestatus AS topic, round(sum(l_quantity), 2) AS value FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM n) GROUP BY 1, 2),
    x AS (SELECT o_custkey AS doc, topic, max(value) FILTER (NOT is_last) AS left_value, max(value) FILTER (is_last) AS right_value FROM n JOIN c ON o_orderkey = l_orderkey GROUP BY 1, 2),
    d AS (SELECT *, CASE WHEN left_value IS NULL OR right_value IS NULL THEN 'missing' WHEN left_value = right_value THEN 'same' ELSE 'changed' END AS diff FROM x)"""


def compared(spark, sf_dir) -> DataFrame:
    """Topics of each document's last two versions, aligned."""
    number = order_versions(spark, sf_dir).select("o_custkey", "o_orderkey", "version_number")
    number = number.withColumn("last", F.max("version_number").over(Window.partitionBy("o_custkey"))).filter("last > 1 AND version_number >= last - 1")
    topics = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("topic")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    both = number.join(topics, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("doc"), "topic", "value", (F.col("version_number") == F.col("last")).alias("is_last"))
    return v.aligned(both.filter("NOT is_last"), both.filter("is_last"), ["doc", "topic"], "value")


@query(f"{COMPARED} SELECT * FROM d")
def compare_versions(spark, sf_dir) -> DataFrame:
    return compared(spark, sf_dir)


@query(f"{COMPARED} SELECT * FROM d WHERE diff <> 'same'")
def compare_only_changes(spark, sf_dir) -> DataFrame:
    return compared(spark, sf_dir).filter("diff <> 'same'")


@query(f"{COMPARED} SELECT count(*) FILTER (diff <> 'same') AS n_differ, count(*) AS n_rows FROM d")
def compare_summary(spark, sf_dir) -> DataFrame:
    return compared(spark, sf_dir).agg(F.count_if(F.col("diff") != "same").alias("n_differ"), F.count("*").alias("n_rows"))


@query()
def word_diff(spark, sf_dir) -> DataFrame:
    """Word diff of every turn with the turn before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("before", before).filter("before IS NOT NULL")
    return v.diff_table(pairs, ["conv_id", "turn"], "before", "text")
