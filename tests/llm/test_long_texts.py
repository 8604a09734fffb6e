"""Texts of megabytes in the operators whose other tests hold short ones, and the pipeline's edges."""

import random
import re

import pytest

from quillstone.llm import bagminhash, quality_rules, quotation_linking, secret_scan, toxicity
from tests.llm.test_llm import docs, words

SECRET = "password = kX9fQ2mWz7LpR4tB"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(31)
    return "\n".join(words(rng, 12, 50_000) for _ in range(14_000)) + "\n" + SECRET  # over a megabyte


def test_secrets_at_the_end_of_a_long_text(spark, long_text):
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs(spark, [long_text, "short", None])).collect()}
    start = long_text.index("password")
    assert len(long_text) > 1_000_000
    assert [(s["kind"], s["start"], s["end"]) for s in got[0]["base"]] == [("assign", start, start + len(SECRET))]
    assert got[1]["base"] == [] and got[2]["base"] == []


def test_quality_counts_of_a_long_text(spark, long_text):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = quality_rules.judge(docs(spark, [long_text + "\n" + long_text.split("\n")[0]]), labels).first()
    own = (long_text + "\n" + long_text.split("\n")[0]).split()
    windows = {}
    for i in range(len(own) - 2):
        windows.setdefault(tuple(own[i : i + 3]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    assert (row["n_words"], row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == (len(own), sum(map(len, own)), 1, len(repeated))


def test_toxicity_of_a_long_text(spark, long_text):
    rng = random.Random(5)
    texts = [words(rng, 30, 50) + (" vile" if i % 2 else " kind") for i in range(60)] + [long_text + " vile" * 20_000]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs(spark, texts), toxicity.fit(docs(spark, texts), labels)).collect()
    assert len(rows) == 61 and {r["doc_id"] for r in rows} == set(range(61))


def test_near_copies_of_a_long_text(spark, long_text):
    cut = long_text[:400_000]
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_classes(docs(spark, [cut, cut + " more words", long_text[400_000:800_000]])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_quotations_of_a_long_message(spark, long_text):
    quoted = "\n".join("> " + line for line in long_text.split("\n")[:3000])
    rows = [(1, 0, "user", long_text), (1, 1, "assistant", quoted + "\nMy answer.")]
    got = quotation_linking.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 2 and {r["turn"] for r in got} == {0, 1}
    assert [r["parent_turn"] for r in got if r["turn"] == 1] == [0]


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(77)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    same, near = words(rng, 150, 5000), words(rng, 150, 5000)
    rows = [(1, same), (1, same), (2, same), (None, same), (None, words(rng, 80, 5000)), (3, near), (6, near + " and more"), (7, near + " and"), (7, near + " or"), (4, None), (None, ""), (5, words(rng, 60, 5000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, path string"
    for name, own in (("full", rows), ("empty", [])):
        spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "d", "p") for i, t in own], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    now = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, f"{tmp_path}/full").write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert sorted(now.columns) == sorted(c.split()[0] for c in schema.split(", "))
    kept = sorted(((r["doc_id"], (r["text"] or "")[:20]) for r in now.collect()), key=str)
    texts = [t for _, t in kept]
    # one row of the equal texts, one of the empty ones, one of the near copies
    assert texts.count(same[:20]) == 1 and texts.count("") == 1 and texts.count(near[:20]) == 1 and len(kept) == 5
    assert (2, same[:20]) in kept and (4, "") in kept and (3, near[:20]) in kept
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert len({r["sequence_id"] for r in pieces}) >= 1 and re.fullmatch("[0-9]+", str(sum(r["length"] for r in pieces)))
