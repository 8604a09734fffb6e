"""Claims are judged beside their chunk; texts and hits are not shuffled."""

import random

from quillstone.operators import evidence
from quillstone.sources.workspace import settings


def by_hand(claim, text, weight):
    """Best covered share, and of the windows that fit, by trying every window."""
    terms, words = list(dict.fromkeys(claim)), text
    must = {t for t in terms if t.isdigit() or t in evidence.NEGATIONS}
    best = fit = None
    for i, w in enumerate(words):
        if w not in terms:
            continue
        window = words[i : i + 2 * len(claim)]
        hits = [k for k, x in enumerate(window) if x in terms]
        share = sum(weight[t] for t in set(window) & set(terms)) / sum(weight[t] for t in terms)
        clear = bool(set(terms) & set(evidence.NEGATIONS)) or not set(window[: hits[-1]]) & set(evidence.NEGATIONS)
        best = max(share, best or 0.0)
        if must <= set(window) and clear:
            fit = max(share, fit or 0.0)
    return best, fit


def test_windows_by_brute_force():
    import numpy as np

    rng = random.Random(5)
    letters = ["a", "b", "c", "d", "7", "30", "not", "never", "e", "f", "g"]
    weight = {w: rng.random() + 0.1 for w in letters}
    for _ in range(2000):
        text = rng.choices(letters, k=rng.randint(0, 40))
        claim = rng.choices(letters, k=rng.randint(1, 6))
        at = {w: np.array([i for i, x in enumerate(text) if x == w]) for w in set(text)}
        got = evidence.best_window(list(dict.fromkeys(claim)), 2 * len(claim), weight, at) or (None, None)
        for a, b in zip(got, by_hand(claim, text, weight), strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_texts_are_not_shuffled_for_a_few_cited_chunks(spark, tmp_path):
    said = spark.range(200_000).selectExpr("id", "repeat('x', 60) AS claim", "CAST(id % 9 AS int) AS chunk")
    said.write.parquet(f"{tmp_path}/said")
    chunks = spark.range(2000).selectExpr("CAST(id AS int) AS chunk", "repeat(CAST(id AS string), 50) AS text")
    chunks.write.parquet(f"{tmp_path}/chunks")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "20k"}):
        plan = evidence.chunks_of(spark.read.parquet(f"{tmp_path}/chunks"), spark.read.parquet(f"{tmp_path}/said"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
