"""Claims on one chunk are judged in parts."""

from quillstone.operators import evidence


def test_a_chunk_of_many_claims_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(evidence, "TOGETHER", 20)
    chunks = spark.createDataFrame([(1, "rent is due on day 5"), (2, "rent is never due"), (3, None)], "chunk int, text string")
    rows = [(i, ("rent is due", "rent is due on day 6", "...")[i % 3], (1, 1, 1, 2, 3, 9, None)[i % 7]) for i in range(210)]
    claims = spark.createDataFrame(rows, "id int, claim string, chunk int")
    got = {r["id"]: r["verdict"] for r in evidence.judge_claims(claims, chunks).collect()}
    for i, claim, chunk in rows:
        there = chunk in (1, 2, 3)
        want = "INSUFFICIENT_EVIDENCE" if not there else "supported" if claim == "rent is due" and chunk == 1 else "unsupported"
        assert (i, got[i]) == (i, want)
