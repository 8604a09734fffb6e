"""The text operators against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bagminhash, bpe, exact_dedup, html_extract, packing, quality_rules, quotation_linking, secret_scan, suffix_dedup, toxicity
from quillstone.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, spans string, bands string"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "b") for i, t in zip(ids, texts, strict=True)], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t", "a", "a", "é" * 300, "x y z " * 4000]


# Exact dedup


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup(spark, tmp_path, digest):
    texts = ["A b", "a B", "a b ", None, "", "É", "é", "x", "X", "x"] + [f"t{i % 7}" for i in range(40)]
    docs(spark, texts).repartition(3).write.parquet(f"{tmp_path}/d")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(lower)].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_exact(spark, f"{tmp_path}/d", digest=digest).collect()}
    assert got == want


def test_exact_dedup_edges(spark, tmp_path):
    docs(spark, ["same", "same", "same", "same", "other"], [5, 5, None, 3, None]).write.parquet(f"{tmp_path}/d")
    rows = exact_dedup.dedup_exact(spark, f"{tmp_path}/d").collect()
    same = [r for r in rows if r["group_size"] == 4]
    assert len(rows) == 5 and {r["keep_id"] for r in same} == {5} and sum(r["kept"] for r in same) == 1
    assert [r["kept"] for r in rows if r["group_size"] == 1] == [True]
    docs(spark, []).write.parquet(f"{tmp_path}/none")
    assert exact_dedup.dedup_exact(spark, f"{tmp_path}/none").count() == 0
    odd = docs(spark, ["q", "Q", "r"]).withColumnsRenamed({"key": "_metadata", "ids": "__file", "spans": "__at_row"})
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(odd).collect()) == [1, 2] and exact_dedup.drop_copies(odd).columns == odd.columns
    kept = exact_dedup.drop_copies(docs(spark, ["q", "Q", "r"]))
    assert kept.columns == docs(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


# Byte-level BPE


def test_bpe_round_trip(spark):
    rng = random.Random(1)
    texts = [*ODD, "  two  spaces \n\n end ", words(rng, 30_000), "ab" * 40_000, "<|endoftext|> 'll é x"]
    got = {r["doc_id"]: r for r in bpe.encode_bpe(docs(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    whole = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        ids = np.frombuffer(got[i]["ids"], "<u4").tolist()
        assert bytes(got[i]["decoded"]).decode() == (t or "")
        assert len(ids) == got[i]["n_tokens"]
        if len(t or "") < 70_000 or i == 8:
            assert ids == whole.encode_ordinary(t or "")
    assert bpe.encode_bpe(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_safe_pieces_keep_the_matches():
    import regex

    rng = random.Random(2)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b1", " ", "  ", "\n", ",", "'s", "é", "\t"]) for _ in range(60))
        pieces = list(bpe.safe_pieces(text, 7))
        assert "".join(pieces) == text
        assert [m for p in pieces for m in pattern.findall(p)] == pattern.findall(text)


# Secret scan

SECRET = "k9Zq3vT0bXw7LmR2yPa8Jd5HsUe1GfNc4KoVt6Bi"


def brute_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        found += [(m.start(), 1 + (kind == "hex"), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(3)
    parts = ["password", "SECRET", "token", "api_key", "apiſkey", ":", "=", " ", '"', "abc", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "x", "KEY"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert secret_scan.base_spans(text) == brute_base(text)


def test_random_strings_pass_and_words_fail():
    rng = random.Random(4)

    def judged(token, encoding):
        return secret_scan.battery(secret_scan.codes(token, encoding)[None, :], len(secret_scan.ALPHABETS[encoding]))[0]

    b64 = secret_scan.ALPHABETS["base64"]
    passed = sum(judged("".join(rng.choice(b64) for _ in range(60)), "base64") >= 0.001 for _ in range(300))
    assert passed > 290
    assert judged("internationalisationofcontracts", "lower") < 0.05
    assert judged("a" * 40, "hex") == 0.0
    assert [secret_scan.infer_encoding(t) for t in ("0123", "0a", "0A", "gh", "a/B", "a-B", "é")] == ["decimal", "hex", "HEX", "lower", "base64", "base64url", None]


def test_power_and_false_discoveries(spark):
    """Planted random strings are found, ordinary long runs among prose are left."""
    rng = random.Random(27)
    stock = ["contract", "notice", "renewal", "payment", "clause", "tenant", "liability", "warranty", "the", "of", "and", "shall", "within", "days", "agreement", "party"]
    texts, planted = [], {}
    for i in range(400):
        w = [rng.choice(stock) for _ in range(rng.randrange(80, 200))]
        joiner = rng.choice(["", "_", "-", "/"])
        w.insert(20, joiner.join(rng.choice([str.title, str.lower])(rng.choice(stock)) for _ in range(rng.randrange(4, 9))))
        if i % 8 == 0:
            letters = secret_scan.ALPHABETS[rng.choice(["base64", "base64url", "BASE36", "base32"])]
            planted[i] = "".join(rng.choice(letters) for _ in range(rng.randrange(32, 64)))
            w.insert(40, planted[i])
        texts.append(" ".join(w))
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in secret_scan.find_secrets(docs(spark, texts)).collect()}
    hits = sum(any(len(s) >= 20 and s in planted[i] for s in found[i]) for i in planted)
    false = sum(s not in planted.get(i, "") for i, spans in found.items() for s in spans)
    assert hits >= 0.9 * len(planted) and false <= 0.05 * len(planted)


def test_runs_of_mixed_alphabets_are_judged():
    rng = random.Random(25)
    key = "".join(rng.choice(secret_scan.ALPHABETS["base36"].upper() + "abcdefghijkl") for _ in range(40))
    for text, part in ((f"/my-app/{key}", f"app/{key}"), (f"sk-{key}+/{key[:5]}", f"{key}+/{key[:5]}"), ("aB3/x-" * 5, "aB3/x-" * 5), (key, key), ("a/b-c", None)):
        found = [(a, b) for a, b, *_ in secret_scan.candidates(text, [])]
        assert found == ([] if part is None else [(text.index(part), text.index(part) + len(part))])
    both = f"{key}-x+/{key[::-1]}y"
    spans = [both[a:b] for a, b, *_ in secret_scan.candidates(both, [])]
    assert len(spans) == 2 and any(key in s for s in spans) and any(key[::-1] in s for s in spans)


def test_mixed_runs_in_texts(spark):
    key = "/my-app/" + SECRET
    texts = ["the " + "internationalisationalities contract " * 100] * 30
    texts.append(f"{texts[0]} key {key} end")
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, texts)).collect()}
    assert SECRET not in clean[30] and clean[0] == texts[0]


def test_find_secrets(spark):
    rng = random.Random(5)
    prose = ["the " + " ".join(rng.choice(["contract", "notice", "renewal", "internationalisationalities"]) for _ in range(200)) for _ in range(30)]
    texts = [*prose, f"é key {SECRET} end {prose[0]}", "token = abcdef1", *ODD, "t = " + SECRET]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.find_secrets(docs(spark, texts)).collect()}
    assert got[30] == [("random", 6, 6 + len(SECRET))] and got[31] == [("assign", 0, 15)]
    assert all(not got[i] for i in range(30)) and got[len(texts) - 1][0][0] == "random"
    assert all(not got[i] for i in range(32, 32 + len(ODD)))
    assert secret_scan.find_secrets(docs(spark, [])).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, texts)).collect()}
    twice = docs(spark, ["password: abcdef tail", "no secret here at all", "password: abcdef"], [7, 7, None])
    assert sorted(r["text"] for r in secret_scan.redact(twice).collect()) == ["[secret]", "[secret] tail", "no secret here at all"]
    assert clean[30] == f"é key [secret] end {prose[0]}" and clean[31] == "[secret]" and clean[0] == texts[0] and clean[32] is None


def test_benjamini_hochberg_bins():
    rows = [{"stratum": "hex/32", "bin": b, "n": n, "decoys": d} for b, n, d in ((2, 30, 0), (9, 5, 3), (25, 0, 400), (60, 65, 1000))]
    assert secret_scan.cutoff_bins(rows, 0.01) == {"hex/32": 9}
    assert secret_scan.cutoff_bins(rows, 0.0005) == {}
    assert secret_scan.cutoff_bins([dict(r, decoys=0) for r in rows], 0.01) == {}
    assert secret_scan.cutoff_bins([], 0.01) == {}


# Quality rules


def brute_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(w), len(marked)


def test_quality_measures():
    rng = random.Random(6)
    for text in [*ODD, *(words(rng, n, v) for n, v in ((60, 3), (200, 6), (500, 20))), "a b c a b c d\n#x*\n#x*\n \n \n é\x1cf"]:
        row = dict(zip(quality_rules.MEASURES.names, next(quality_rules.measure(1, "en", text)), strict=True))
        t = text or ""
        n, repeated = brute_repeats(t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row["n_words"], row["n_repeat_words"]) == (n, repeated)
        assert row["word_chars"] == sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", t)))
        assert row["n_dup_lines"] == len(lines) - len(set(lines)) and row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))


def test_binomial_tail_is_exact():
    for k, n, p in ((0, 10, 0.2), (3, 50, 0.05), (50, 50, 0.3)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_accepted_steps_limit_false_rejection():
    rng = np.random.default_rng(7)
    misses = taken = 0
    for _ in range(300):  # step k rejects (k + 1) / 200 of good texts; so much is known here
        step = np.append(np.arange(20), quality_rules.NEVER)
        good = rng.multinomial(600, [0.005] * 20 + [0.9])
        at = quality_rules.accepted_step(step, good, np.ones(21), 0.03, 0.05)
        misses += (at + 1) / 200 > 0.03
        taken += at >= 0
    assert misses <= 300 * 0.05 + 10 and taken > 250
    ends = np.array([0, quality_rules.NEVER])
    assert quality_rules.accepted_step(ends, np.array([0, 98]), np.array([5, 0]), 0.03, 0.05) == -1  # too few labels
    assert quality_rules.accepted_step(ends, np.array([0, 99]), np.array([5, 0]), 0.03, 0.05) == 0
    assert quality_rules.accepted_step(ends, np.array([0, 99]), np.array([0, 5]), 0.03, 0.05) == -1  # catches nothing


def test_cutoff_path():
    none = np.zeros(101)
    good, bad = ({r: none.copy() for r in quality_rules.RULES} for _ in range(2))
    good["symbol"][2], good["upper"][40] = 50, 1
    bad["symbol"][20], bad["symbol"][8], bad["upper"][30] = 3, 4, 2
    path = quality_rules.cutoff_path(good, bad)
    # Both symbol steps cost no good text; the upper step costs one.
    assert path == [("symbol", 14), ("symbol", 5), ("upper", 15)]
    first = quality_rules.first_steps(path)
    assert (first["symbol"][15], first["symbol"][14], first["symbol"][5], first["upper"][16], first["shout"][100]) == (0, 1, quality_rules.NEVER, 2, quality_rules.NEVER)


def test_judge(spark):
    """Good texts stay within alpha, bad ones of three kinds are caught, per language."""
    rng = random.Random(8)
    rows = []
    for i in range(1600):
        text, kind = words(rng, 120), i % 8
        if kind == 1:
            text = " ".join(f"{w}***" for w in text.split())
        elif kind == 2:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif i % 97 == 0:
            text += " ###"
        rows.append((i, text, ("en", "de", None, "")[i // 8 % 4], int(kind not in (1, 2))))
    table = spark.createDataFrame([(i, t, lang, "x", 0) for i, t, lang, _ in rows] + [(1600 + i, t, "en", "x", 0) for i, t in enumerate(ODD)] + [(1700, rows[1][1], "fr", "x", 0)], "doc_id long, text string, lang string, stratum string, fold int")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows if i % 10 < 9] + [(0, 0), (5, None)], "doc_id long, quality int")
    found = quality_rules.judge(table, labels)
    got = {r["doc_id"]: r for r in found.collect()}
    assert sum(not got[i]["kept"] for i, _, _, q in rows if q) <= 0.03 * 1200
    assert np.mean([not got[i]["kept"] for i, _, _, q in rows if not q]) > 0.95
    assert not got[1600]["kept"] and got[1600]["base_failed"] and len(got) == 1600 + len(ODD) + 1
    assert got[1700]["kept"] and got[1700]["cut_symbol"] is None  # a stratum without labels
    none = quality_rules.judge(table, labels.filter("false")).collect()
    assert all(r["kept"] for r in none if r["doc_id"] < 1600)
    assert quality_rules.judge(docs(spark, []), labels).count() == 0


# Suffix-array dedup


def brute_cut(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                covered[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(int)))
        out.append((bytes(np.frombuffer(d, np.uint8)[~covered]), [tuple(e) for e in edges.reshape(-1, 2).tolist()]))
    return out


def test_suffix_dedup(spark):
    rng = random.Random(9)
    shared = words(rng, 80)
    base = words(rng, 300)
    texts = [words(rng, 200) for _ in range(10)]
    texts += [words(rng, 50) + shared + words(rng, 50) for _ in range(6)]
    texts += [base.replace(f"w{k}", "zz") for k in range(12)] + [base, base]
    texts += ["ab" * 400, "x" * 900, "é" * 250, shared[:200], shared[:199], *ODD]
    ids = [*range(len(texts) - 1), None]
    got = sorted((bytes(r["kept"]), [tuple(s) for s in r["spans"]], r["n_bytes"]) for r in suffix_dedup.cut_repeats(docs(spark, texts, ids)).collect())
    want = sorted((k, s, len((t or "").encode())) for (k, s), t in zip(brute_cut(texts, 200), texts, strict=True))
    assert got == want
    assert suffix_dedup.cut_repeats(docs(spark, [])).count() == 0


def test_suffix_dedup_repeated_rows(spark):
    rng = random.Random(10)
    text = words(rng, 400)
    table = docs(spark, [text] * 60 + [words(rng, 100)], [1] * 60 + [2])
    rows = suffix_dedup.keyed(table, "doc_id", "text")
    contexts = suffix_dedup.contexts(np.frombuffer(text.encode(), np.uint8))
    assert suffix_dedup.shared_contexts(rows).count() == 60 * len(contexts[0])  # not the square of 60
    got = suffix_dedup.cut_repeats(table).collect()
    assert sorted(len(r["kept"]) for r in got)[:60] == [0] * 60 and len(got) == 61


def test_suffix_dedup_of_texts_over_a_piece(spark):
    rng = random.Random(29)
    data = np.frombuffer(words(rng, 3000).encode(), np.uint8)
    assert suffix_dedup.contexts(data)[3].sum() == len(data) - 199
    piece = suffix_dedup.PIECE
    passage = words(rng, 200, 10**6)[:900]
    filler = words(rng, 300_000, 10**7)
    texts = [filler[: piece - 400] + passage + filler[piece : 2 * piece + 300], words(rng, 50, 10**6) + passage, words(rng, 50, 10**6)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffix_dedup.cut_repeats(docs(spark, texts)).collect()}
    start = len(texts[1]) - 900
    assert got == {0: [(piece - 400, piece + 500)], 1: [(start, start + 900)], 2: []}


def test_suffix_dedup_splits_heavy_anchors(spark, monkeypatch):
    rng = random.Random(30)
    line = words(rng, 60, 10**6)[:240]
    texts = [f"{words(rng, 60)}\n{line}\n{words(rng, 60)}" for _ in range(40)] + [words(rng, 100) for _ in range(3)]
    texts += [texts[0][50:], texts[1]]
    monkeypatch.setattr(suffix_dedup, "HEAVY", 5)
    got = {r["doc_id"]: (bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in suffix_dedup.cut_repeats(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts, 200)


def test_column_order_flags_common_prefixes():
    parts = [b"xxabcdefyy", b"zabcdefw", b"abcdef", b"abcxef"]
    before = np.array([2, 1, 0, 0])
    found = {c: set(d.tolist()) for c, d in suffix_dedup.column_order(np.zeros(4, np.int64), before, parts, 5)}
    assert found == {0: {0, 1, 2}, 1: {0, 1, 2}}
    apart = dict(suffix_dedup.column_order(np.array([0, 1, 2, 3]), before, parts, 5))
    assert apart == {}


# Toxicity


def test_toxicity(spark):
    rng = random.Random(11)
    bad_words = ["scoundrel", "blockhead", "nitwit", "dullard"]

    def text(toxic):
        w = words(rng, 80).split()
        for _ in range(rng.randrange(1, 12) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad_words) + rng.choice(["", ".", "ly"])
        return " ".join(w)

    marks = [int(i % 5 == 0) for i in range(600)]
    texts = [text(m) for m in marks] + ODD
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, m) for i, m in enumerate(marks[:400])] + [(3, None, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(table, labels)
    got = {r["doc_id"]: r for r in toxicity.score(table, chain).collect()}
    held_out = [got[i]["toxic"] == bool(marks[i]) for i in range(400, 600)]
    assert np.mean(held_out) > 0.97 and len(got) == len(texts)
    assert not any(got[600 + i]["toxic"] for i in range(len(ODD))) and got[601]["p_toxic"] == 0.0
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}
    assert toxicity.score(docs(spark, []), chain).count() == 0
    assert not any(r["toxic"] for r in toxicity.score(table, toxicity.fit(table, labels.filter("false"))).collect())


def test_batches_score_like_single_terms(spark):
    """The batch scores against the chain worked out term by term."""
    rng = random.Random(31)
    index = {"w:bad": 0, "s:nast": 1, "w:nasty": 2, "w:fine": 3}
    weights = [np.array([0.5, 1.0, -0.25, -2.0, 0.1]), np.array([1.5, 0.5, 0.75, -1.0, 2.0, -0.5])]
    chain = toxicity.Chain(index, weights, 0.5)
    texts = [" ".join(rng.choice(["bad", "Nasty", "nastier", "fine", "other", "12"]) for _ in range(rng.randrange(0, 30))) for _ in range(600)] + ODD
    for text, got in zip(texts, chain.probabilities([t or "" for t in texts]), strict=True):
        own, p = re.findall(r"[^\W\d_]+", (text or "").lower()), []
        n = [own.count("bad"), sum(w.startswith("nast") for w in own), own.count("nasty"), own.count("fine")]
        for w in weights:
            z = sum(a * math.log1p(b) for a, b in zip(w, n, strict=False)) + sum(a * b for a, b in zip(w[4:], p, strict=False)) + w[-1]
            p.append(1 / (1 + math.exp(-z)) if own else 0.0)
        assert got.tolist() == pytest.approx(p)


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3))
    y = [(x[:, 0] > cut).astype(float) for cut in (1, 0.5, 0)]
    y[0][:50] = np.nan
    every = [np.arange(3)] * (toxicity.FOLDS + 1)
    weights, out = toxicity.fit_chain(x, y, np.arange(400) % 5, every)
    assert [len(w) for w in weights] == [4, 5, 6]
    cut = toxicity.best_threshold(out, y[2])
    assert 0 < cut < 1 and np.mean((out > cut) == y[2]) > 0.95
    # A fold's terms are not those of its own labels: here only fold 0 may use the first column.
    picked = [np.arange(3), *[np.arange(1, 3)] * toxicity.FOLDS]
    _, out = toxicity.fit_chain(x, y[2:], np.arange(400) % 5, picked)
    right = (out > 0.5) == y[2]
    assert right[::5].mean() > 0.9 > right[np.arange(400) % 5 > 0].mean()


# BagMinHash


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(13)
    errors = []
    for _ in range(80):
        e = np.unique(rng.integers(0, 2**62, 60).astype(np.uint64))
        w = rng.integers(1, 20, len(e))
        v = np.maximum(1, w + rng.integers(-4, 5, len(e)))
        a, b = (e, w), (e[:50], v[:50])
        s = bagminhash.signatures([a, b], 512)
        errors.append((s[0] == s[1]).mean() - bagminhash.weighted_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.03


def test_weighted_jaccard():
    a, b = bagminhash.multiset("a b c d e f a b c d e f"), bagminhash.multiset("A b c d e f")
    assert bagminhash.weighted_jaccard(a, a) == 1.0 and bagminhash.weighted_jaccard(a, b) == 2 / 8
    assert bagminhash.weighted_jaccard(bagminhash.multiset(""), bagminhash.multiset(" ")) == 1.0


def test_near_classes(spark):
    rng = random.Random(14)
    texts = [words(rng, 150, 5000) for _ in range(40)]
    for i in range(12):  # copies with one word changed, of one text, and a chain
        w = texts[0].split()
        w[i * 10] = "changed"
        texts.append(" ".join(w))
    for i in range(6):
        w = texts[-1].split()
        w[5 + i * 20] = "link"
        texts.append(" ".join(w))
    texts += ["One two three", "one TWO three", "one two", *ODD, "x y z " * 4000]
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_classes(docs(spark, texts)).collect()}
    sets = [bagminhash.multiset(t or "") for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bagminhash.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in range(len(texts))}
    kept = bagminhash.drop_near_copies(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {root(i) for i in range(len(texts))}
    assert bagminhash.near_classes(docs(spark, [])).count() == 0
    assert {(r["doc_id"], r["class_id"]) for r in bagminhash.near_classes(docs(spark, ["q r s", "q r s"], [None, 4])).collect()} == {(None, None), (4, 4)}
    # Rows of one identifier are judged each by its own text, and clashing columns stay.
    again = docs(spark, [texts[0], texts[1], texts[40]], [7, 9, 9]).withColumnsRenamed({"key": "__gone", "ids": "__hash"})
    kept = bagminhash.drop_near_copies(again)
    assert kept.columns == again.columns and sorted(r["text"] for r in kept.collect()) == sorted(texts[:2])


def test_near_classes_inside_a_family_of_a_template(spark):
    """Pairs at 0.8 among hundreds of texts that resemble each other at 0.75."""
    rng = random.Random(24)
    template = words(rng, 430, 10**6)
    texts = []
    for _ in range(150):  # pairs that share 30 more words, and so 0.85
        shared = words(rng, 30, 10**6)
        texts += [f"{template} {shared} {words(rng, 40, 10**6)}" for _ in range(2)]
    sets = [bagminhash.multiset(t) for t in texts]
    near = [(j, i) for i in range(len(texts)) for j in range(i) if bagminhash.weighted_jaccard(sets[i], sets[j]) >= 0.8]
    assert near == [(i, i + 1) for i in range(0, len(texts), 2)]
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_classes(docs(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}
    # The template alone is near to all of them, and shares no rare shingle with any.
    got = bagminhash.near_classes(docs(spark, [*texts, template])).collect()
    assert {r["class_id"] for r in got} == {0}


def test_bag_signatures_match_plain_recursion():
    """The vectorised processes against one process at a time, without early ends."""

    def plain(bag, registers):
        best = np.full(registers, np.inf)
        one = lambda x: np.array([x])
        with np.errstate(over="ignore"):
            for s, w in zip(*bag, strict=True):
                todo, k = [], 0
                while k == 0 or 1 << (k - 1) < w:
                    low = 0 if k == 0 else 1 << (k - 1)
                    todo.append((bagminhash.mix(one(s) + np.uint64(k + 1) * np.uint64(bagminhash.GOLDEN)), low, max(low, 1), 0.0, None))
                    k += 1
                for seed, low, width, time, register in todo:
                    for number in range(1, 4000 if width == 1 else 2):
                        if register is None:
                            t, r = (x[0] for x in bagminhash.next_point(seed, one(np.uint64(number)), one(width), one(time), registers))
                        else:
                            t, r, register = time, register, None
                        time = t
                        if low + width <= w:
                            best[r] = min(best[r], t)
                    if width > 1:
                        side, half = int(bagminhash.mix(seed ^ np.uint64(bagminhash.GOLDEN))[0] & np.uint64(1)), width // 2
                        parts = [(bagminhash.mix(seed + np.uint64(2 + h) * np.uint64(bagminhash.GOLDEN)), low + h * half, half, t, r if h == side else None) for h in (0, 1)]
                        todo += [p for p in parts if p[1] < w]
        return best

    rng = np.random.default_rng(26)
    for weights in ([1, 2, 3], [5, 8, 13], [1, 1, 30]):
        bag = np.sort(rng.integers(0, 2**62, 3).astype(np.uint64)), np.array(weights)
        assert np.array_equal(bagminhash.signatures([bag], 16)[0], plain(bag, 16))


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100}


# Packing


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rng = random.Random(15)
    texts = [words(rng, rng.choice([3, 40, 300, 900, 3000])) for _ in range(150)] + ODD + ["Iß ça — 'll  x\n\n1234", "hello <|endoftext|> world<|endoftext|><|endoftext|>x  <|endoftext"]
    texts.append(" <|endoftext|> a b" * 9000)
    rows = packing.pack(docs(spark, texts).repartition(2), RANKS, public_tokenizers.PATTERN, special=packing.added_tokens(JSON)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r["start"])
        want = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == want
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and {r["doc_tokens"] for r in own} == {len(want)}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # full, or of a length that needs no padding
    assert packing.pack(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_fill_finds_the_best_sum():
    rng = random.Random(16)
    for _ in range(300):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(1, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        total, used = packing.fill(counts, sorted(counts, reverse=True), room)
        assert total == max(s for s in sums if s <= room) == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


# Quotation linking


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nSecond part"),
        (1, 1, "assistant", "On Monday X wrote:\n> Hello there.\n> How are you?\n\nFine."),
        (1, 2, "user", "unrelated"),
        (1, 3, "user", "> > Hello  THERE.\n> Fine.\nGood."),
        (1, 4, "a", "> unrelated\nyes"),
        (1, 5, "a", "> nothing known\nno"),
        (1, 6, "u", ">> Hello there.\n> Good.\nthanks"),
        (1, 7, "u", "> How are you?\n> yes\n> unrelated by far\nmixed"),
        (2, 0, "u", None),
        (2, 1, "u", ">\nblank"),
        (None, 0, "u", "x"),
        (None, 1, "u", "> x\ny"),
        (3, 0, "u", "same"),
        (3, 0, "u", "same"),
        (3, None, "u", "> same"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit("clash"))
    got = {(r["conv_id"], r["turn"], r["position"]): r for r in quotation_linking.link_quotations(df).collect()}
    assert len(got) == len(rows)
    one = sorted((r["position"], r["turn"], r["parent_turn"], r["depth"]) for (c, _, _), r in got.items() if c == 1)
    assert one == [(0, 0, None, 0), (1, 1, 0, 1), (2, 3, 1, 2), (3, 6, 3, 3), (4, 2, None, 0), (5, 4, 2, 1), (6, 7, 4, 2), (7, 5, None, 0)]
    by_turn = {r["turn"]: r for (c, _, _), r in got.items() if c == 1}
    assert by_turn[1]["text"] == "Fine." and by_turn[5]["n_linked"] == 0 and by_turn[3]["n_linked"] == 2
    assert got[(None, 1, 1)]["parent_turn"] == 0 and got[(2, 1, 1)]["text"] == "blank"
    assert sorted(p for c, _, p in got if c == 3) == [0, 1, 2]
    assert quotation_linking.link_quotations(df.filter("false")).count() == 0


def brute_quotations(rows):
    """(conv, turn, text) -> position, parent turn, depth, passages, linked; turns are distinct."""
    quoted = re.compile(r"^[ \t]*>")

    def norm(t):
        return " ".join(t.split()).lower()

    own, found = {}, {}
    for c, t, text in rows:
        own[c, t] = "\n".join(x for x in text.split("\n") if not quoted.match(x)).strip("\n") if any(map(quoted.match, text.split("\n"))) else text
        runs = []
        for x in text.split("\n"):
            marks = re.match(r"(?:[ \t]*>)+", x)
            level = marks[0].count(">") if marks else 0
            body = norm(x[marks.end() :]) if marks else ""
            if not (runs and runs[-1][0] == level):
                runs.append((level, []))
            runs[-1][1].append(body)
        found[c, t] = [(level, [b for b in bodies if b]) for level, bodies in runs if level and any(bodies)]
    units = {}
    for (c, t), text in sorted(own.items()):
        for u in {norm(text), *map(norm, text.split("\n\n")), *map(norm, text.split("\n"))} - {""}:
            units.setdefault((c, u), t)
    out, children = {}, defaultdict(list)
    for (c, t), passages in found.items():
        best, linked = None, 0
        for level, bodies in passages:
            first = units.get((c, " ".join(bodies)), t)
            if first >= t:
                votes = Counter(units[c, b] for b in bodies if units.get((c, b), t) < t)
                first = max(((n, u) for u, n in votes.items()), default=(0, None))[1]
            if first is not None and first < t:
                linked += 1
                best = max(best or (-99, 0, 0), (-level, len(bodies), first))
        parent = best[2] if best else None
        out[c, t] = [parent, len(passages), linked]
        children[c, parent].append(t)

    def visit(c, parent, depth, at):
        for t in sorted(children[c, parent]):
            out[c, t] += [depth, len(at)]
            at.append(t)
            visit(c, t, depth + 1, at)
        return at

    for c in {c for c, _ in out}:
        visit(c, None, 0, [])
    return {k: tuple(v) for k, v in out.items()}


def test_quotations_against_brute_force(spark):
    rng = random.Random(28)
    rows = []
    for c in range(12):
        said = []
        for t in range(rng.choice([1, 9, 30])):
            lines = [words(rng, 3, 40) for _ in range(rng.randrange(1, 4))]
            if said and rng.random() < 0.7:
                source = rng.choice(said).split("\n")
                part = source[rng.randrange(len(source)) :]
                lines = [("> " if rng.random() < 0.8 else ">> ") + x for x in part] + lines
            said.append("\n".join(lines))
            rows.append((c, t, said[-1]))
    # A chain in which each message quotes the one before, and a message that most reply to.
    rows += [(90, t, f"> word{t - 1}\nword{t}" if t else "word0") for t in range(150)]
    rows += [(91, t, f"> root\nsay{t}" if t else "root") for t in range(200)]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["n_passages"], r["n_linked"], r["depth"], r["position"]) for r in quotation_linking.link_quotations(df).collect()}
    assert got == brute_quotations(rows)


# HTML extraction


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav>menu</nav><article><h1>T&amp;t</h1><p>a <b>b</b>c\n d<p>e<br>f</article><footer>x", "T&t\na bc d\ne\nf"),
        ("<main>m<article>y<div class='comments'>z</div><header>t</header></article></main>", "y\nt"),
        ("<main><p>only<aside>no</aside></main><p>out", "only"),
        ('<article><div class="ad">buy</div><script>"</p>"</script><form>f</form>ok<!-- c --></article>', "ok"),
        ("<article><p class='a>b'>x &lt;tag&gt; &#233;</p></article>", "x <tag> é"),
        ("<div class='cookie-notice'>no</div><p>plain page</p>", "plain page"),
        ("", ""),
        (None, ""),
        ("<article></article>", ""),
        ("<<>><p", "<<>><p"),
        ("<article><p class='ad'>buy<p>first<p>second</article>", "first\nsecond"),
        ("<article><ul><li class=ad>buy<li>a<ul><li>b</ul><li>c</ul><table><tr><td class=ad>x<td>y<tr><td>z</table></article>", "a\nb\nc\ny\nz"),
        ("<article>let <math><mi>x</mi>=<mn>1</mn></math> and <svg><text>label</text></svg> <object>shown</object><p id='related-work'>prior</p></article>", "let x=1 and label shown\nprior"),
        ("<article><p>a<div>b</p>c</div></article><p>d", "a\nb\nc"),
        ("<article><p>a <b>b <p>c</article>", "a b\nc"),
        ("<p>a<!-- b --> c <![CDATA[x]]>d <? e ?>f<p title='>'>g", "a c d f\ng"),
        ('<article>a</article><p title="x>b', "a"),
        ("<article>a <span class=ad><b>buy</span> c</article>", "a\nc"),
    ],
)
def test_main_text(html, text):
    roles, blocks = html_extract.parse(html or "")
    assert next(html_extract.settle_row(1, "u", roles, "\n".join(blocks), None, 8))[2] == text


@pytest.mark.parametrize("part", ['<a "', "<p>", "<p></div>", "<div></span>", '<a ">"', "<p '>", "<script>", "<table><p>", "<b></i>", "<div class=ad>x", "<!--", "&amp", "<li>", "</p>"])
def test_parsing_takes_time_in_proportion(part):
    import time

    def seconds(n):
        start = time.process_time()
        html_extract.parse(part * n)
        return time.process_time() - start

    seconds(2000)
    assert min(seconds(32_000) for _ in range(2)) < 8 * seconds(8000) + 0.3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<body class="has-sidebar"><article>a</article><div class="sidebar">no</div></body>', "a"),
        ('<body class="search login"><p>a</p></body>', "a"),
        ('<div class="content with-sidebar"><article>a</article></div>', "a"),
        ('<div class="widget"><article>a</article></div>', "a"),
        ('<div id="related"><main>a</main></div>', "a"),
        ('<article class="post no-comments">a</article>', "a"),
        ('<article class="widget">a</article>', "a"),
        ('<article>a<p class="social-history">b</p><div class="share-buttons">no</div></article>', "a\nb"),
        ('<div class="widget"><article>a</article></div><div class="comments"><article>no</article></div>', "a"),
        ('<article class="comments">a</article>', "a"),
        ('<article>a</article><div class="comment-list"><article>no</article></div>', "a"),
        ('<p>a</p><div class="comments"><article>no</article></div>', "a"),
        ('<div class="ad-slot-3">no</div><div class="nav_top">no</div><p>a</p>', "a"),
    ],
)
def test_main_text_with_layout_classes(html, text):
    roles, blocks = html_extract.parse(html)
    kept = [b for r, b in zip(roles, blocks, strict=True) if r == "m"] or [b for r, b in zip(roles, blocks, strict=True) if r == "u"]
    assert "\n".join(kept) == text


def test_repeated_substrings_against_brute_force(spark):
    rng = random.Random(17)
    common = [words(rng, 12, 30) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(common) if rng.random() < 0.4 else words(rng, rng.randrange(1, 25), 12) for _ in range(5)]
        rows.append((i, f"http://h{i % 3}/{i}", "".join(f"<p>{p}" for p in parts)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.main_texts(df, min_tokens=5).collect()}
    streams = {i: [w for b in html_extract.parse(h)[1] for w in b.split(" ")] for i, _, h in rows}
    where = defaultdict(set)
    for i, w in streams.items():
        for j in range(len(w) - 4):
            where[i % 3, tuple(w[j : j + 5])].add(i)
    for i, _, h in rows:
        covered = [False] * len(streams[i])
        for j in range(len(streams[i]) - 4):
            if len(where[i % 3, tuple(streams[i][j : j + 5])]) > 1:
                covered[j : j + 5] = [True] * 5
        kept, at = [], 0
        for block in html_extract.parse(h)[1]:
            own = block.split(" ")
            hit, at = covered[at : at + len(own)], at + len(own)
            left = [w for w, x in zip(own, hit, strict=True) if not x] if 2 * sum(hit) >= len(own) else own
            kept += [" ".join(left)] if left else []
        assert (got[i]["n_repeated"], got[i]["n_tokens"], got[i]["text"]) == (sum(covered), len(covered), "\n".join(kept))


def test_host_boilerplate(spark):
    rng = random.Random(18)
    note = words(rng, 20)
    rows = [(i, f"http://H.example/p{i}", f"<body><p>{note}</p><p>{words(rng, 30)}</p><p>{words(rng, 30)}</p><p>{words(rng, 30)}</p></body>") for i in range(5)]
    rows += [(9, "http://other.example/", f"<p>{note}</p>"), (10, None, None), (10, None, None), (None, "::", "<p>x")]
    # The same article under a second address, and one page that quotes another's sentence.
    rows += [(20, "http://h.example/print", rows[0][2].replace("<body>", "<body><p>print view"))]
    rows += [(21, "http://h.example/q", f"<p>{words(rng, 40)} {rows[1][2].split('<p>')[2][:60]} {words(rng, 40)}<p>{words(rng, 60)}")]
    # Article pages: what they share stays, and the array sees what is left out.
    rows += [(30 + i, "http://a.example/", f"<nav>{note}</nav><article><p>{note}<p>{words(rng, 30)}</article>") for i in range(2)]
    # The host is looked at because of a page without article; of a host without such pages nothing is asked.
    rows += [(50, "http://a.example/", f"<p>{words(rng, 30)}"), (60, "http://b.example/", f"<article>{note}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "row", "content", "start", "roles")})
    got = html_extract.main_texts(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(5):
        assert text[i].split("\n") == re.findall("<p>(.*?)</p>", rows[i][2])[1:]
    assert text[9] == note and text[10] == "" and text[None] == "x"
    assert text[20] == "print view\n" + text[0]
    assert text[21] == "\n".join(rows[10][2].split("<p>")[1:])
    assert all(text[30 + i].startswith(note) for i in range(2)) and {r["n_removed"] for r in got if (r["page_id"] or 0) in (30, 31)} == {20}
    assert text[60] == note and [r["n_removed"] for r in got if r["page_id"] == 60] == [None]
    assert html_extract.main_texts(df.filter("false")).count() == 0


# Pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(19)
    base = words(rng, 120, 5000)
    texts = [words(rng, 100, 5000) for _ in range(20)] + [base, base.upper(), base + " more", f"password = {SECRET} " + words(rng, 60, 5000), None, ""]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs(spark, texts).select(columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append((name, now.count()))
        if i < 4:
            assert now.columns == columns
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert kept == {*range(20), 21, 23, 25}
    assert SECRET not in "".join(r["text"] for r in spark.read.parquet(f"{tmp_path}/3").collect() if r["text"])
    assert {r["doc_id"] for r in now.collect()} == kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1][1]


def test_sha_of_query_columns(spark):
    """The queries' digests are those of the operators' outputs."""
    row = bpe.encode_bpe(docs(spark, ["abc"]), RANKS, public_tokenizers.PATTERN).select("ids", F.sha2("ids", 256).alias("h"), F.crc32("ids").alias("c")).first()
    assert row["h"] == hashlib.sha256(bytes(row["ids"])).hexdigest() and row["c"] >= 0
