"""Index writes by manifest, the vector index, text vectors and claims."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import embedding, evidence
from quillstone.operators.retrieval import dense_topk
from quillstone.operators.vector_index import VectorIndex
from quillstone.sources.manifest import Conflict, ManifestTable


def rows(spark, values):
    return spark.createDataFrame(values, "id int, version string, tenant string")


@pytest.fixture
def store(spark, tmp_path):
    table = ManifestTable(spark, f"file://{tmp_path}/t", ["tenant"])
    table.replace(rows(spark, [(1, "v1", "a"), (2, "v2", "a/b c"), (3, "v3", "b"), (4, "v4", "b")]))
    return table


def content(df):
    return sorted(tuple(r) for r in df.select("id", "version", "tenant").collect())


def test_upsert_twice_is_once_and_touches_its_partition(spark, store):
    before = store.manifest()["parts"]
    new = rows(spark, [(30, "v3", "b"), (31, "v3", "b")])
    store.upsert(new, "version")
    once = content(store.read())
    store.upsert(new, "version")
    assert content(store.read()) == once == [(1, "v1", "a"), (2, "v2", "a/b c"), (4, "v4", "b"), (30, "v3", "b"), (31, "v3", "b")]
    after = store.manifest()["parts"]
    assert {k for k in before if before[k] != after[k]} == {'["b"]'}


def test_readers_see_a_write_whole_or_not_at_all(spark, store):
    old = store.read()
    store.replace(rows(spark, [(9, "v9", "b")]))
    assert content(old) == [(1, "v1", "a"), (2, "v2", "a/b c"), (3, "v3", "b"), (4, "v4", "b")]
    assert content(store.read()) == [(1, "v1", "a"), (2, "v2", "a/b c"), (9, "v9", "b")]
    assert content(store.read(1)) == content(old)
    # a writer that died before its manifest leaves files that nothing reads
    rows(spark, [(7, "v7", "a")]).write.partitionBy("tenant").parquet(f"{store.path}/generation-dead")
    assert content(store.read()) == [(1, "v1", "a"), (2, "v2", "a/b c"), (9, "v9", "b")]
    store.vacuum(keep=1)
    assert content(store.read()) == [(1, "v1", "a"), (2, "v2", "a/b c"), (9, "v9", "b")] and store.version() == 2
    with pytest.raises(Exception, match="(?i)not"):
        store.manifest(1)


def test_the_second_of_two_writers_is_told(spark, store):
    seen = store.version()
    store.replace(rows(spark, [(5, "v5", "a")]), seen=seen)
    with pytest.raises(Conflict):
        store.replace(rows(spark, [(6, "v6", "a")]), seen=seen)
    assert (5, "v5", "a") in content(store.read())


def test_delete_keeps_other_tenants_and_drops_empty_partitions(spark, store):
    store.delete(rows(spark, [(1, "", "a"), (3, "", "b"), (2, "", "zz")]), "id")
    assert content(store.read()) == [(2, "v2", "a/b c"), (4, "v4", "b")]
    assert '["a"]' not in store.manifest()["parts"]
    version = store.version()
    assert store.delete(rows(spark, [(2, "", "nobody")]), "id") == version
    with pytest.raises(LookupError):
        ManifestTable(spark, f"{store.path}-none", ["tenant"]).read()


def test_vector_index_recall_and_pruning(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * 3
    data = [(int(i % 3), i, (centres[i % 30] + rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(data, "tenant int, id int, vector array<double>").cache()
    index = VectorIndex(spark, f"file://{tmp_path}/v").ensure(df)
    asked = df.filter("id % 100 = 7").select("id", "vector")
    exact = {(r["query"], r["id"]) for r in dense_topk(df.select("id", "vector"), asked, 10).collect()}
    assert {(r["query"], r["id"]) for r in index.search(asked, 10).collect()} == exact
    probes = index.probes_for(asked, 10, 0.9)
    found = {(r["query"], r["id"]) for r in index.search(asked, 10, probes=probes).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and index.scanned(asked, probes) < 0.3
    again = VectorIndex(spark, f"file://{tmp_path}/v").ensure(df)
    assert again.table.version() == 1 and np.allclose(again.centres, index.centres)
    own = index.search(asked, 10, tenant=1)
    files = {f for f in index.table.read(only={k for k in index.table.manifest()["parts"] if k.startswith("[1,")}).inputFiles()}
    assert all("tenant=1/" in f for f in files) and {r["id"] % 3 for r in own.collect()} == {1}


def test_text_vectors(spark):
    corpus = spark.createDataFrame([(1, "the tenant pays the rent"), (2, "The tenant pays rent"), (3, "entirely other words here"), (4, ""), (5, None)], "id int, text string")
    embedder = embedding.TextEmbedder(corpus)
    got = {r["id"]: np.array(r["vector"]) for r in embedder.embed(corpus).collect()}
    assert set(got) == {1, 2, 3} and all(len(v) == 768 and math.isclose(np.linalg.norm(v), 1) for v in got.values())
    assert got[1] @ got[2] > 0.7 > 0.2 > got[1] @ got[3]
    asked = {r["id"]: np.array(r["vector"]) for r in embedder.embed(spark.createDataFrame([(9, "tenants paying rents"), (8, "zzz")], "id int, text string")).collect()}
    assert asked[9] @ got[2] > asked[9] @ got[3] and math.isclose(np.linalg.norm(asked[8]), 1)


CHUNK = "The parties agree. Either party may terminate this agreement upon thirty (30) days written notice to the other party. Fees are payable monthly in advance without deduction."


@pytest.mark.parametrize(
    ("claim", "verdict"),
    [
        ("Either party may terminate upon thirty (30) days written notice", "supported"),
        ("Either party may terminate upon sixty (60) days written notice", "unsupported"),
        ("Either party may not terminate upon thirty (30) days written notice", "unsupported"),
        ("Fees are payable monthly in advance", "supported"),
        ("Fees are payable yearly in arrears", "unsupported"),
        ("Fees are payable without deduction", "supported"),
    ],
)
def test_claims_by_text(spark, claim, verdict):
    filler = [(i, f"Unrelated chunk number {i} about other matters of the parties.") for i in range(2, 30)]
    chunks = spark.createDataFrame([(1, CHUNK), *filler, (40, "word " * 3000 + CHUNK + " more" * 3000)], "chunk int, text string")
    claims = spark.createDataFrame([(1, claim, 1), (2, claim, 99), (3, claim, 5), (4, claim, 40), (5, claim, 99), (5, claim, 1)], "id int, claim string, chunk int")
    got = {r["id"]: r["verdict"] for r in evidence.judge_claims(claims, chunks).collect()}
    assert got == {1: verdict, 2: "INSUFFICIENT_EVIDENCE", 3: "unsupported", 4: verdict, 5: verdict}


def test_answers_with_an_unsupported_claim_are_not_given(spark):
    answers = spark.createDataFrame([(1, "One. Two 3.5 is there! "), (2, "..."), (3, "No mark")], "a int, text string")
    claims = evidence.split_claims(answers)
    assert [(r["a"], r["claim"]) for r in claims.orderBy("a", "claim_no").collect()] == [(1, "One"), (1, "Two 3.5 is there"), (3, "No mark")]
    judged = claims.withColumn("verdict", F.when(F.col("claim_no") == 0, "supported").otherwise("unsupported"))
    got = {r["a"]: (r["n_claims"], r["groundedness"], r["verdict"]) for r in evidence.grounded(judged, ["a"]).collect()}
    assert got == {1: (2, 0.5, "INSUFFICIENT_EVIDENCE"), 3: (1, 1.0, "answered")}


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_search", "agent_rounds", "delete_then_upsert", "worker_transitions", "rate_limit_bucket"])
def test_working_tables_go_when_nothing_reads_them(spark, name):
    from pathlib import Path

    from quillstone.plans import catalogue
    from quillstone.sources.workspace import roots, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "quillstone"
    before = set(folder.iterdir()) if folder.exists() else set()
    df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    left = {p.name for p in set(folder.iterdir()) - before}
    assert all(any(p in r for r in roots(df)) for p in left) and df.count() > 0


def test_a_table_can_become_empty(spark, tmp_path):
    table = ManifestTable(spark, f"file://{tmp_path}/t", ["tenant"])
    table.upsert(rows(spark, [(1, "v1", "a")]), "version")
    table.delete(rows(spark, [(1, "v1", "a")]), "id")
    assert content(table.read()) == [] and table.manifest()["parts"] == {}
    table.upsert(rows(spark, [(2, "v1", "b")]), "version")
    assert content(table.read()) == [(2, "v1", "b")]
