"""Text features are counted by column: a word is hashed once for many texts."""

from collections import Counter

import pyarrow as pa

from quillstone.operators import embedding


def test_buckets_of_texts_by_column(monkeypatch):
    texts = ["a bb ccc a", "", "  \n ", "größe 😀x größe größe", "bb\nbb  a"] * 30
    asked = Counter()
    monkeypatch.setattr(embedding, "bucket", lambda f, own=embedding.bucket: asked.update([f]) or own(f))
    got = [dict(zip(b.tolist(), n.tolist(), strict=True)) for b, n in embedding.text_buckets(pa.array(texts))]
    assert max(n for f, n in asked.items() if f.startswith("w:")) == 1
    monkeypatch.undo()
    for text, found in zip(texts, got, strict=True):
        want = Counter()
        for w in text.split():
            framed = f"<{w}>"
            want.update([embedding.bucket("w:" + w), *(embedding.bucket(framed[i : i + 3]) for i in range(len(w)))])
        assert found == dict(want)
