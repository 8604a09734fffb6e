"""Tenant-scoped reads; a nation is the tenant of its customers, a source of its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.tenancy import TenantTable, allowed, denied, payload_filter, scope_sizes
from quillstone.plans.catalogue import query
from quillstone.sources.tables import table

TENANT = 7
CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def customers(spark, sf_dir, tenant=TENANT) -> TenantTable:
    return TenantTable(table(spark, sf_dir, "customer"), "c_nationkey", tenant, "c_custkey")


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_nationkey = 7")
def tenant_list(spark, sf_dir) -> DataFrame:
    return customers(spark, sf_dir).rows()


@query("SELECT count(*) AS n_rows FROM customer WHERE c_nationkey = 7")
def tenant_count(spark, sf_dir) -> DataFrame:
    return customers(spark, sf_dir).count()


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'")
def tenant_filter_eq(spark, sf_dir) -> DataFrame:
    return customers(spark, sf_dir).rows(c_mktsegment="BUILDING")


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 200 OFFSET 3")
def tenant_page_capped(spark, sf_dir) -> DataFrame:
    return customers(spark, sf_dir).page(offset=3, limit=500)


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_custkey = 1")
def tenant_get_hit(spark, sf_dir) -> DataFrame:
    home = table(spark, sf_dir, "customer").filter("c_custkey = 1").first()["c_nationkey"]
    return customers(spark, sf_dir, home).get(1)


@query(f"SELECT {CUSTOMER} FROM customer WHERE false")
def tenant_get_cross_tenant(spark, sf_dir) -> DataFrame:
    home = table(spark, sf_dir, "customer").filter("c_custkey = 1").first()["c_nationkey"]
    return customers(spark, sf_dir, home + 1).get(1)


@query(f"SELECT {CUSTOMER.replace('c_nationkey', '7 AS c_nationkey')} FROM customer WHERE c_nationkey = 3")
def tenant_insert_stamped(spark, sf_dir) -> DataFrame:
    return customers(spark, sf_dir).stamped(customers(spark, sf_dir, 3).rows())


@query(f"SELECT {CUSTOMER} FROM customer WHERE NOT (c_nationkey = 7 AND c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 7))")
def tenant_delete(spark, sf_dir) -> DataFrame:
    own = customers(spark, sf_dir)
    return own.without(own.rows().agg(F.min("c_custkey")).first()[0])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src0' AND doc_id IN (0, 1, 5, 100, 120, 140) AND lang = 'fr'")
def payload_filter_scoped(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    return payload_filter(docs, "source", "src0", {"doc_id": [0, 1, 5, 100, 120, 140]}, lang="fr").drop("source")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src0'")
def payload_filter_empty_scope(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    return payload_filter(docs, "source", "src0", {"doc_id": []}).drop("source")


@query(
    """WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN [] ELSE [conv_id, conv_id + 1] END AS scope FROM conversations)
    SELECT conv_id, CASE WHEN len(scope) = 0 THEN (SELECT count(*) FROM documents) ELSE (SELECT count(*) FROM documents WHERE list_contains(scope, doc_id)) END AS n_documents FROM c"""
)
def conversation_scope(spark, sf_dir) -> DataFrame:
    """Documents a conversation may use: an empty list stands for all of them."""
    scope = F.expr("CASE WHEN conv_id % 2 = 0 THEN CAST(array() AS array<bigint>) ELSE array(conv_id, conv_id + 1) END")
    scopes = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("scope", scope)
    return scope_sizes(scopes, "conv_id", "scope", table(spark, sf_dir, "documents"), "doc_id", "n_documents")


MATRIX = """(VALUES ('ADMIN', ['document:read','document:upload','document:delete','query:run','analysis:run','user:manage','evaluation:run']),
  ('LEGAL_MANAGER', ['document:read','document:upload','document:delete','query:run','analysis:run','evaluation:run']),
  ('ANALYST', ['document:read','document:upload','query:run','analysis:run']), ('VIEWER', ['document:read','query:run'])) t(role, granted)"""


@query(f"SELECT role, unnest(granted) AS permission FROM {MATRIX}")
def rbac_allowed(spark, sf_dir) -> DataFrame:
    return allowed(spark)


@query(
    f"""WITH m AS (SELECT * FROM {MATRIX}), p AS (SELECT unnest(granted) AS permission FROM m WHERE role = 'ADMIN')
    SELECT role, permission FROM m, p WHERE NOT list_contains(granted, permission)"""
)
def rbac_denied(spark, sf_dir) -> DataFrame:
    return denied(spark)


@query(
    f"""WITH m AS (SELECT * FROM {MATRIX}), u AS (SELECT DISTINCT user_id, ['ADMIN','LEGAL_MANAGER','ANALYST','VIEWER'][1 + user_id % 4] AS role FROM events)
    SELECT role, count(*) AS n_users FROM u JOIN m USING (role) WHERE list_contains(granted, 'document:delete') GROUP BY role"""
)
def users_who_may_delete(spark, sf_dir) -> DataFrame:
    roles = F.array(*map(F.lit, ("ADMIN", "LEGAL_MANAGER", "ANALYST", "VIEWER")))
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("role", F.get(roles, (F.col("user_id") % 4).cast("int")))
    may = allowed(spark).filter("permission = 'document:delete'")
    return users.join(may, "role", "left_semi").groupBy("role").agg(F.count("*").alias("n_users"))
