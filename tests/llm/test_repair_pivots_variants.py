"""Role repair, the pivot index and spelling variants against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from quillstone.llm import exact_dedup, html_extract, pivot_index, role_repair, spelling_variants

TURNS = "conv_id long, turn long, role string, text string, segment string, at string, fault string, copies string"


def conversations(spark, rows):
    """Conversations with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], TURNS)


# Role repair


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults_of(rows):
    seen, found = set(), []
    for *_, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, faults):
    """Every sequence of edits that is not dearer than deleting all; the least (cost, audit)."""
    best = (4 * len(rows), "D" * len(rows), [])

    def go(k, cost, audit, said, inserts):
        nonlocal best
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in said)):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said)):
            best = min(best, (cost, audit, said))
        if inserts < 3:
            for role in ("user", "assistant"):
                go(k, cost + 3, audit + "I", [*said, (role, "")], inserts + 1)
        if k < len(rows):
            *_, role, text = rows[k]
            go(k + 1, cost + 4, audit + "D", said, 0)
            if faults[k] in ("", "truncated"):
                more = 3 * (faults[k] == "truncated")
                go(k + 1, cost + more, audit + "K", [*said, (role, text)], 0)
                for other in ("user", "assistant"):
                    go(k + 1, cost + 3 + more, audit + "R", [*said, (other, text)], 0)

    go(0, 0, "", [], 0)
    return best


def brute_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        faults = faults_of(own)
        cost, audit, said = cheapest(own, faults)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def reported(df):
    columns = ["gaps", *role_repair.COUNTS, "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in role_repair.repair_report(role_repair.damaged(df)).collect()}


@pytest.mark.parametrize("segment", [2, 4096])
def test_role_repair_equals_every_sequence_of_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(role_repair, "SEGMENT", segment)
    rng = random.Random(segment)
    texts = ["Yes.", "No!", "and then", "Why? ", "", " \t", "A. B", None, "x"]
    rows = []
    for conv in range(60):
        rows += [(conv, rng.randrange(8), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for _ in range(rng.randrange(1, 6))]
    rows += [(None, None, "user", "Hi."), (None, None, "assistant", "Hi."), (99, None, "user", "Q?"), (99, 5, "assistant", "A."), (99, None, "user", "Q?")]
    assert reported(conversations(spark, rows)) == brute_repair(rows)


def test_role_repair_of_a_long_conversation_is_that_of_one_segment(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), f"t{rng.randrange(150)}" + rng.choice([".", ""])) for k in range(600)]
    rows += [(8, 3, "user", "same.")] * 500
    whole = reported(conversations(spark, rows))
    monkeypatch.setattr(role_repair, "SEGMENT", 64)
    parts = reported(conversations(spark, rows).repartition(7))
    assert parts == whole and re.fullmatch("[KRDI]{600,}", whole[7][6])
    copies = 500 * (2 if zlib.crc32(b"8:3") % 20 == 3 else 1)
    assert whole[8][6] == "K" + "D" * (copies - 1) + "I"


def test_role_repair_keeps_texts_and_answers_empty_tables(spark):
    long = "word " * 60_000 + "end."
    rows = [(1, 1, "user", long), (1, 2, "assistant", long[:-1] + "!")]
    fine = conversations(spark, rows).withColumn("copies", role_repair.F.lit(1))
    turns, report = role_repair.repair(fine)
    assert [(r["role"], r["text"], r["edit"]) for r in turns.orderBy("segment", "seq").collect()] == [("user", long, "K"), ("assistant", rows[1][3], "K")]
    assert report.first()["cost"] == 0 and report.first()["audit"] == "KK"
    assert reported(conversations(spark, [])) == {}
    gone = next(t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert reported(conversations(spark, [(5, gone, "user", "a.")])) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# Pivot index


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, key int, list int, ball int")


def brute_links(rows, threshold=0.95):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links = [0] * len(rows), defaultdict(set)
    unit = [np.array(v) / np.abs(v).max() if usable(v) else None for _, v in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
            n[i] += 1
            n[j] += 1
            links[i].add(j)
            links[j].add(i)
    out = []
    for i, (own, _) in enumerate(rows):
        seen, agenda = {i}, [i]
        while agenda:
            for j in links[agenda.pop()] - seen:
                seen.add(j)
                agenda.append(j)
        named = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((own, n[i], min(named, default=None), own == min(named, default=None)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def near(rng, v, cosine):
    """A vector at that cosine from v."""
    v = v / np.linalg.norm(v)
    w = rng.normal(size=len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


@pytest.mark.parametrize("block", [1024, 16])
def test_pivot_index_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(40, 24))
    x = [rng.normal(size=24) for _ in range(300)]
    x += [near(rng, c, 0.995) * rng.uniform(0.1, 9) for c in centres[:8] for _ in range(20)]  # within a ball
    x += [near(rng, centres[9], 0.998) for _ in range(90)]
    x += [centres[10]] * 30
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(x)]
    assert found(pivot_index.near_vectors(vectors(spark, rows))) == brute_links(rows)


def test_pivot_index_recall_at_the_threshold(spark):
    """Pairs just over the threshold, of random directions: the hardest to find."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    x = [*base, *(near(rng, v, 0.951) for v in base), *(near(rng, v, 0.949) for v in base[:500])]
    got = found(pivot_index.near_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])))
    linked = sum(r[1] for r in got)
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    every = int((unit @ unit.T >= 0.95).sum()) - len(x)
    assert every >= 3000 and 0.9 * every <= linked <= every


def test_pivot_index_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e290]), (11, [1e-300, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 3.0]), (12, [0.0, -1.0])]
    got = found(pivot_index.near_vectors(vectors(spark, rows)))
    want = brute_links(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert found(pivot_index.near_vectors(vectors(spark, []))) == []


# Spelling variants


def near_words(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc}:{run}".encode())
            words[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}
    forms, counts = {}, {}
    for w in words:
        around = [v for v in words if near_words(w, v)]
        counts[w] = len(around)
        best = min(around, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, counts[w], words[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def variants(spark, rows):
    df = spark.createDataFrame([(i, t, "k", "l", "n") for i, t in rows], "doc_id long, text string, key string, word string, n string")
    return sorted((tuple(r) for r in spelling_variants.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_spelling_variants_equal_all_pairs(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(7, 10))) for _ in range(25)]
    family = ["abcdefgh", "abcdefg", "abcdefghi", "bacdefgh", "abcdefgx", "Abcdéfgh", "abcdÉfgh", "hgfedcba", "abcdefghij"]
    rows = []
    for doc in range(120):
        words = [rng.choice(base[: 1 + rng.randrange(25)]) for _ in range(40)] + rng.sample(family, 3)
        words += ["abcdefgh"] * 20 * (doc % 3 == 0) + ["abcdefghi"] * 2
        rows.append((doc, rng.choice([" ", "-", "1", "\n"]).join(words)))
    rows += [(500, None), (501, ""), (502, "a" * 30_000 + " " + "a" * 30_000), (503, "b" * 30_001 + ","), (503, "b" * 30_001), (504, "b" * 30_000 + " " + "b" * 30_000)]
    assert variants(spark, rows) == brute_variants(rows)


def test_spelling_variants_edges(spark):
    assert variants(spark, []) == [] and variants(spark, [(1, "short words only")]) == []
    assert [r[0] for r in variants(spark, [(1, "anagram ANAGRAM"), (None, "nagaram nagaram")])] == ["anagram", "nagaram"]


def test_spelling_variants_follow_forms_to_the_last(spark):
    rows = [(1, "stationxyz " * 3), (2, "stationxy " * 45), *((i, "stationx " * 50) for i in range(3, 14)), *((i, "station " * 60) for i in range(14, 114))]
    got = variants(spark, rows)
    assert got == brute_variants(rows)
    roots = {w: root for w, _, root, *_ in got}
    assert len({roots[w] for w in ("stationxyz", "stationxy", "stationx", "station")}) == 1


# HTML extraction


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>before <script>x()</script> after</p></article>", "before after"),
        ("<article><p>one <custom-el>two</custom-el> three</p></article>", "one two three"),
        ("<article><p>x <ruby>y<rt>z</rt></ruby> w</p></article>", "x yz w"),
        ("<article><p>a <select><option>no</select> b <noscript>no</noscript> c</p></article>", "a b c"),
        ("<article><p>a<style>p{}</style>b</p><p>c<template>no</template> d</p></article>", "ab\nc d"),
        ("<article>a<br>b<li>c<td>d</article>", "a\nb\nc\nd"),
    ],
)
def test_only_block_elements_end_blocks(html, text):
    roles, blocks = html_extract.parse(html)
    assert "\n".join(blocks) == text and set(roles) == {"m"}


def test_boilerplate_longer_than_the_pages_own_text(spark):
    rng = random.Random(6)

    def block(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))

    notes = [block(60) for _ in range(3)]
    own = [block(40) for _ in range(6)]
    rows = [(i, f"http://h/{i}", "".join(f"<div>{b}</div>" for b in (notes[0], own[i], *notes[1:]))) for i in range(6)]
    article = f"<div>{block(80)}</div><div>{block(50)}</div>"
    rows += [(10 + i, f"http://g/{i}", f"<div>{notes[0]}</div><div>{'ab'[i]}</div>{article}") for i in range(2)]
    rows += [(20 + i, f"http://g/x{i}", f"<div>{notes[0]}</div><div>{block(70)}</div>") for i in range(4)]
    got = {r["page_id"]: r for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i]["text"] == own[i] and got[i]["n_repeated"] == got[i]["n_removed"] == 180
    for i in range(2):
        assert got[10 + i]["text"] == "ab"[i] + "\n" + article.replace("<div>", "").replace("</div>", "\n").strip() and got[10 + i]["n_removed"] == 60
    assert all(notes[0] not in got[20 + i]["text"] for i in range(4))


# Exact dedup over several batches; working tables


def test_a_second_batch_meets_the_first(spark, tmp_path):
    def batch(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")

    def found():
        df = exact_dedup.dedup_exact(spark, f"file://{tmp_path}/docs", state_dir=f"file://{tmp_path}/state")
        return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()}

    batch([(1, "Same"), (2, "other"), (3, None)])
    assert found() == {1: (1, 1, True), 2: (2, 1, True), 3: (3, 1, True)}
    batch([(9, "sAME"), (4, ""), (5, "new")])
    want = {1: (9, 2, False), 2: (2, 1, True), 3: (4, 2, False), 9: (9, 2, True), 4: (4, 2, True), 5: (5, 1, True)}
    assert found() == want
    assert found() == want  # nothing new: the state answers alone


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op8_exact_dedup", "op11_role_repair", "op12_pivot_index", "op13_spelling_variants", "pipeline"])
def test_only_what_the_result_reads_stays(spark, name):
    import __spark_entry__
    from quillstone.sources.workspace import roots, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "quillstone"
    before = set(folder.iterdir()) if folder.exists() else set()
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    left = {p.name for p in set(folder.iterdir()) - before}
    assert all(any(p in r for r in roots(df)) for p in left) and df.count() > 0
