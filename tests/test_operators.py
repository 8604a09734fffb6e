"""Operators on small planted tables."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import ingest, portfolio, retrieval, text, versions
from quillstone.operators.tenancy import TenantTable, allowed, denied, payload_filter
from quillstone.sources.objects import ObjectStore, checked_uploads, safe_key


def test_tenant_scope_fails_closed(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], "org string, id int, kind string")
    own = TenantTable(df, "org", "a", "id")
    assert own.count().first()[0] == 1
    assert own.require(1)["kind"] == "x"
    with pytest.raises(LookupError):
        own.require(2)
    with pytest.raises(TypeError):
        TenantTable(df, "missing", "a", "id")
    with pytest.raises(ValueError):
        TenantTable(df, "org", None, "id")
    with pytest.raises(Exception, match="nope"):
        own.rows(nope=1).collect()
    with pytest.raises(ValueError):
        own.page(offset=-1)
    assert {r["org"] for r in own.stamped(df).collect()} == {"a"}
    assert own.without(2).count() == 2 and own.without(1).count() == 1


def test_payload_filter_empty_list_is_no_condition(spark):
    df = spark.createDataFrame([("a", "d1", "v2"), ("a", "d2", "v2"), ("b", "d1", "v2")], "org string, doc string, ver string")
    assert payload_filter(df, "org", "a", {"doc": ["d1"], "ver": ["v2"]}).count() == 1
    assert payload_filter(df, "org", "a", {"doc": []}).count() == 2
    assert payload_filter(df, "org", "a").count() == 2


def test_role_matrix(spark):
    pairs = {tuple(r) for r in allowed(spark).collect()}
    assert len(pairs) == 19 and denied(spark).count() == 9
    assert ("VIEWER", "query:run") in pairs and ("VIEWER", "document:upload") not in pairs
    assert ("ANALYST", "document:delete") not in pairs and ("LEGAL_MANAGER", "document:delete") in pairs
    assert ("LEGAL_MANAGER", "user:manage") not in pairs and ("ADMIN", "user:manage") in pairs


@pytest.mark.parametrize(
    ("rows", "want"),
    [([("a", True, True), ("b", True, True)], ("ready", 200)), ([("a", False, True), ("b", True, True)], ("not_ready", 503)), ([("a", True, True), ("b", False, False)], ("degraded", 200)), ([], ("ready", 200))],
)
def test_readiness(spark, rows, want):
    assert tuple(ingest.readiness(spark.createDataFrame(rows, "name string, up boolean, critical boolean")).first()) == want


def events(spark, rows):
    schema = "job string, event_id int, ts int, stage string, phase string, error_class string"
    return spark.createDataFrame([(j, i, i, s, p, e) for i, (j, s, p, e) in enumerate(rows)], schema)


def test_job_state(spark):
    steps = [("ok", s, p, None) for s in ("parse", "ocr", "chunk", "embed", "index") for p in ("start", "end")]
    bad = [("bad", s, p, None) for s in ("parse", "ocr") for p in ("start", "end")] + [("bad", "chunk", "start", None), ("bad", "chunk", "fail", "RuntimeError")]
    state = {r["job"]: r for r in ingest.job_state(events(spark, steps + bad)).collect()}
    assert (state["ok"]["status"], state["ok"]["progress"], state["ok"]["current_stage"]) == ("SUCCEEDED", 100, None)
    b = state["bad"]
    assert (b["status"], b["progress"], b["current_stage"], b["attempts"], b["error_message"]) == ("FAILED", 45, "chunk", 1, "RuntimeError in stage chunk")
    asked = spark.createDataFrame([("ok",), ("none",)], "job string")
    assert {r["job"]: r["status"] for r in ingest.lookup_jobs(asked, ingest.job_state(events(spark, steps))).collect()} == {"ok": "SUCCEEDED", "none": "missing"}


def test_exposure_keeps_first_seen_order(spark):
    rows = [("d0", 0, "high"), ("d3", 1, "medium"), ("d4", 2, "high"), ("d0", 3, "high"), ("d4", 4, "medium"), ("d0", 5, "medium"), ("d0", 6, "low")]
    got = portfolio.exposure(spark.createDataFrame(rows, "doc string, pos int, severity string")).orderBy(F.desc("weight"), "first_pos").collect()
    assert [(r["doc"], r["high"], r["medium"], r["low"]) for r in got] == [("d0", 2, 1, 1), ("d4", 1, 1, 0), ("d3", 0, 1, 0)]
    assert got[0]["width"] == 100.0


def test_word_diff():
    left, right = versions.word_diff("not less than thirty (30) days", "not less than sixty (60) days")
    assert [t for t, k in left if k == "del"] == ["thirty", "(30)"] or "thirty (30)" in [t for t, k in left if k == "del"]
    assert "".join(t for t, _ in left) == "not less than thirty (30) days" and "".join(t for t, _ in right) == "not less than sixty (60) days"
    assert versions.word_diff("same text", "same text") == ([("same text", "same")], [("same text", "same")])
    assert versions.word_diff("", "a b") == ([], [("a b", "add")]) and versions.word_diff(None, None) == ([], [])


def test_alignment(spark):
    a = spark.createDataFrame([("t1", "x"), ("t2", "y"), ("t4", None)], "topic string, v string")
    b = spark.createDataFrame([("t1", "x"), ("t2", "z"), ("t3", "w"), ("t4", None)], "topic string, v string")
    assert {r["topic"]: r["diff"] for r in versions.aligned(a, b, ["topic"], "v").collect()} == {"t1": "same", "t2": "changed", "t3": "missing", "t4": "same"}


def test_dense_topk_blocks_agree(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    asked = vectors.filter("id % 10 = 0")
    once = sorted(map(tuple, retrieval.dense_topk(vectors, asked, 5).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.dense_topk(vectors, asked, 5).collect())) == once and len(once) == 30
    assert retrieval.dense_topk(vectors, vectors.filter("false"), 5).count() == 0


def test_tables_and_images(spark):
    html = "<table><tr><th>A</th><td>b <b>c</b></td></tr><tr><td>d</td></tr></table><img alt=x src='i.png'>"
    row = spark.createDataFrame([(html,)], "h string").select(text.html_tables(F.col("h")).alias("t"), text.image_sources(F.col("h")).alias("i")).first()
    assert row["t"] == [[["A", "b c"], ["d"]]] and row["i"] == ["i.png"]


def test_rounds_leave_one_table(spark):
    import os

    from quillstone.sources.workspace import materialise

    now = materialise(spark.range(5), "round")
    first = now.working_path.removeprefix("file://")
    then = materialise(now.filter("id > 2"), "round", replaces=now)
    assert not os.path.exists(first) and then.count() == 2
    materialise(then, "round", replaces=spark.range(3))
    assert then.count() == 2


def test_object_store(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}")
    store.put("tenants/a/doc.pdf", b"%PDF-1")
    store.put("tenants/a/bad.pdf", b"nope")
    assert store.get("tenants/a/doc.pdf") == b"%PDF-1" and store.exists("tenants/a/doc.pdf")
    checked = {r["path"].rsplit("/", 1)[1]: r["rejected"] for r in checked_uploads(store.scan("tenants/a/*")).collect()}
    assert checked == {"doc.pdf": None, "bad.pdf": "magic"}
    store.delete("tenants/a/doc.pdf")
    store.delete("tenants/a/doc.pdf")
    with pytest.raises(LookupError):
        store.get("tenants/a/doc.pdf")
    for key in ("../../etc/passwd", "/etc/passwd", ""):
        with pytest.raises(ValueError):
            safe_key(key)


def test_job_stream_matches_batch(spark, tmp_path):
    from quillstone.streaming import jobs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    rows = [(1, 0, "parse", "start"), (1, 1, "parse", "end"), (2, 2, "parse", "start"), (2, 3, "parse", "fail")]
    spark.createDataFrame(rows, "job long, seq long, stage string, phase string").coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("job long, seq long, stage string, phase string").parquet(f"{tmp_path}/log")
    got = {r["job"]: r for r in jobs.run_to_table(jobs.job_stream(stream), "update").collect()}
    assert (got[1]["status"], got[1]["progress"], got[2]["status"], got[2]["attempts"]) == ("RUNNING", 25, "FAILED", 1)


def test_word_diff_against_brute_force():
    """The longest common subsequence, deletions first, on random token lists."""
    import functools
    import random

    rng = random.Random(5)
    for _ in range(150):
        a, b = ("".join(rng.choice(["a", "b", "c", "d"]) + rng.choice([" ", "  "]) for _ in range(rng.randrange(9))) for _ in range(2))
        x, y = versions.TOKEN.findall(a), versions.TOKEN.findall(b)

        @functools.cache
        def common(i, j, x=x, y=y):
            if i == len(x) or j == len(y):
                return 0
            return 1 + common(i + 1, j + 1) if x[i] == y[j] else max(common(i + 1, j), common(i, j + 1))

        want, i, j = ([], []), 0, 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                want[0].append((x[i], "same"))
                want[1].append((y[j], "same"))
                i, j = i + 1, j + 1
            elif j == len(y) or (i < len(x) and common(i + 1, j) >= common(i, j + 1)):
                want[0].append((x[i], "del"))
                i += 1
            else:
                want[1].append((y[j], "add"))
                j += 1
        for got, own in zip(versions.word_diff(a, b), want, strict=True):
            flat = [(t, kind) for text, kind in got for t in versions.TOKEN.findall(text)]
            assert [k for _, k in flat] == [k for _, k in own] and "".join(t for t, _ in flat) == "".join(t for t, _ in own)
            assert all(p[1] != q[1] for p, q in zip(got, got[1:], strict=False))


def test_half_even_rounds_the_binary_number(spark):
    from quillstone.operators.service import half_even

    values = [2.675, 0.125, 0.375, -0.125, 1.005, 2.5, 0.0, 1e9 + 0.125, 99.995, 6.55, 0.015, 123456.785]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", half_even(F.col("v")).alias("r")).collect()
    assert {r["v"]: r["r"] for r in rows} == {v: round(v, 2) for v in values}


def test_nth_of_a_hot_group(spark):
    rows = spark.range(2000).selectExpr("id", "IF(id % 2 = 0, 'hot', IF(id % 5 = 0, CAST(NULL AS STRING), CAST(id AS STRING))) AS k")
    got = {r["id"]: r["nth"] for r in ingest.first_of(rows, ["k"], "id").collect()}
    assert len(got) == 2000 and all(got[i] == i // 2 + 1 for i in range(0, 2000, 2))
    nulls = [i for i in range(1, 2000, 2) if i % 5 == 0]
    assert [got[i] for i in nulls] == list(range(1, len(nulls) + 1)) and got[1] == 1


def test_state_machine_expires(spark, tmp_path):
    """With hours the state has a time to live; a trigger that goes on is stopped by its user."""
    from quillstone.sources.workspace import settings
    from quillstone.streaming import jobs

    schema = "job long, seq long, stage string, phase string"
    spark.createDataFrame([(1, 0, "parse", "start")], schema).write.parquet(f"{tmp_path}/log")
    stream = jobs.job_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), hours=24)
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": jobs.ROCKSDB}):
        query = stream.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            while not spark.table("states").count():
                assert query.isActive or not query.exception()
        finally:
            query.stop()
    assert spark.table("states").first()["status"] == "RUNNING"
