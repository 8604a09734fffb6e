"""Work on pages: few calls a tag, and tokens by column, many pages at a time."""

import sys

import numpy as np
import pyarrow as pa

from quillstone.llm import html_extract


def calls(run) -> int:
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def test_a_tag_takes_few_calls():
    page = '<article><ul>' + '<li class="a b"><a href="/x">one</a> two</li>' * 500 + "</ul><p>three<br><p>four</article>"
    assert calls(lambda: html_extract.parse(page)) < 23 * page.count("<")


def test_a_page_without_repeats_is_not_taken_apart():
    words = " ".join(map(str, range(5000)))
    got = []
    assert calls(lambda: got.extend(html_extract.settle_row(1, "u", "umx", f"{words}\nown\nmenu", None, 8))) < 40
    assert got == [(1, "u", f"{words}\nown", 5002, 0, 0)]


def batch(blocks: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"row": list(range(len(blocks))), "host": ["h"] * len(blocks), "blocks": blocks})


def test_pages_of_a_batch_have_the_entries_they_have_alone():
    rng = np.random.default_rng(3)
    blocks = ["", "one", "", *("\n".join(" ".join(f"w{k}é" for k in rng.integers(0, 9, rng.integers(1, 12))) for _ in range(n)) for n in (1, 5, 1, 1, 40, 3)), "", "a b c d e f g"]
    none = {c: np.empty(0, np.int64) for c in ("row", "back")}
    for min_tokens in (1, 2, 3, 5, 8):
        together = html_extract.anchors(batch(blocks), none, min_tokens)
        alone = [html_extract.anchors(batch([b]), none, min_tokens) for b in blocks]
        assert [together[2].tolist().count(i) for i in range(len(blocks))] == [a.shape[1] for a in alone]
        together[2] = 0
        assert np.array_equal(together, np.concatenate(alone, axis=1))
        assert together[1].sum() == sum(max(0, len(b.split()) - min_tokens + 1) for b in blocks)
        own = {"row": np.arange(len(blocks)).repeat(2), "back": np.zeros(2 * len(blocks), np.int64), "start": np.tile([0, 2], len(blocks)), "windows": np.tile([2, 1], len(blocks))}
        own = {c: v[[len(blocks[r].split()) >= min_tokens + 2 for r in own["row"]]] for c, v in own.items()}
        found = html_extract.suffixes(batch(blocks), own, min_tokens)
        for row, start, key in zip(*found[[2, 4, 0]].tolist(), strict=True):
            text = " ".join(blocks[row].split()[start : start + min_tokens])
            same = {c: np.array([0]) for c in own} | {"windows": np.array([1])}
            assert html_extract.suffixes(batch([text]), same, min_tokens)[0].tolist() == [key]
        assert found.shape[1] == own["windows"].sum()


def test_equal_tokens_have_equal_hashes_wherever_they_stand():
    long = "x" * 70_000
    text, begin, _, page = html_extract.joined([f"a {long} b\na", "y " * 40_000 + f"b {long}z a", "", f"{long} b"])
    words = text.split(b" ")
    hashes = html_extract.token_hashes(text, begin).tolist()
    assert len(words) == len(hashes) == page[-1] and page.tolist() == [0, 4, 40_007, 40_007, 40_009]
    assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes)) == 5
