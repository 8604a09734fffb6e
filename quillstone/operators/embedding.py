"""Text vectors by signed feature hashing: words and letter trigrams, weighted by rarity.

No model is called.  A feature's bucket is the start of its MD5, so that any engine finds the
same one; a bucket has a slot of the vector and a sign.  Rarity is counted per bucket, of which
there are ``BUCKETS``: a task adds up its own texts' buckets, and only these sums are shuffled.
Texts are read twice and never exploded; a text becomes its vector within its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 768
#: Four hexadecimal digits of MD5.
BUCKETS = 1 << 16
#: Texts whose words are numbered together.
SLICE = 256


def bucket(feature: str) -> int:
    return int.from_bytes(md5(feature.encode("utf-8", "surrogatepass")).digest()[:2])


#: Texts share few trigrams, and words in part.
trigram_bucket = lru_cache(1 << 18)(bucket)


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of words: of each itself; of all their trigrams, framed, one after the other; how many trigrams each has."""
    own = np.fromiter((bucket("w:" + w) for w in words), np.int64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    whole = np.ones(len(letters), bool)
    ends = np.cumsum(size + 2)
    whole[ends - 1] = whole[ends - 2] = False
    at = np.flatnonzero(whole)
    found, which = np.unique(letters[at] << 42 | letters[at + 1] << 21 | letters[at + 2], return_inverse=True)
    names = (chr(t >> 42) + chr(t >> 21 & 0x1FFFFF) + chr(t & 0x1FFFFF) for t in found.tolist())
    return own, np.fromiter(map(trigram_bucket, names), np.int64, len(found))[which], size


def text_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, how often each) of every lower-cased text, in order.

    Words are split, numbered and counted by column, and a word is hashed once for a slice of texts.
    """
    for at in range(0, len(texts), SLICE):
        some = texts.slice(at, SLICE)
        split = pc.split_pattern_regex(some, "[ \n]+")
        words = pc.list_flatten(split).dictionary_encode()
        known = words.dictionary.to_pylist()
        if not known:
            yield from ((np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(len(some)))
            continue
        own, trigrams, size = word_buckets(known)
        start = np.cumsum(size) - size
        row = pc.list_parent_indices(split).to_numpy().astype(np.int64)
        pair, n = np.unique(row * len(known) + words.indices.to_numpy().astype(np.int64), return_counts=True)
        row, word = np.divmod(pair, len(known))
        true = size[word] > 0  # the ends of a split may be empty
        row, word, n = row[true], word[true], n[true]
        ends = np.searchsorted(row, np.arange(len(some) + 1))
        for i in range(len(some)):
            w, times = word[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]
            if not len(w):
                yield np.empty(0, np.int64), np.empty(0, np.int64)
                continue
            many = size[w]
            each = trigrams[np.repeat(start[w] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            # Bucket above, count below: sorted, the counts of a bucket stand together.
            both = np.sort(np.concatenate([each << 40 | np.repeat(times, many), own[w] << 40 | times]))
            found = both >> 40
            first = np.flatnonzero(np.diff(found, prepend=-1))
            yield found[first], np.add.reduceat(both & ((1 << 40) - 1), first)


def lowered(texts: DataFrame) -> DataFrame:
    return texts.filter("text IS NOT NULL").select("id", F.lower("text").alias("text"))


def rarity(texts: DataFrame) -> np.ndarray:
    """idf of every bucket over texts (id, text): of one never seen the highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buckets, _ in text_buckets(batch.column(0)):
                df[buckets] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen])], ["bucket", "df"])

    counted = lowered(texts).select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # BUCKETS rows at most
    df = np.zeros(BUCKETS)
    for r in counted:
        df[r["bucket"]] = r["df"]
    return np.log((1 + texts.count()) / (1 + df)) + 1


class TextEmbedder:
    """Vectors of texts by the rarities of one corpus (id, text)."""

    def __init__(self, corpus: DataFrame):
        self.idf = corpus.sparkSession.sparkContext.broadcast(rarity(corpus))  # half a megabyte

    def embed(self, texts: DataFrame) -> DataFrame:
        """id, vector: unit vectors of ``DIMENSIONS`` doubles of texts (id, text); none for a text without words."""
        shared = self.idf

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slot = np.arange(BUCKETS) % DIMENSIONS
            signed = shared.value * (1 - 2 * (np.arange(BUCKETS) // DIMENSIONS % 2))
            for batch in batches:
                for some in (batch.slice(i, 1024) for i in range(0, len(batch), 1024)):
                    dense, some_words = np.zeros((len(some), DIMENSIONS)), np.zeros(len(some), bool)
                    for row, (buckets, tf) in enumerate(text_buckets(some.column(1))):
                        some_words[row] = len(buckets) > 0
                        dense[row] = np.bincount(slot[buckets], (1 + np.log(tf)) * signed[buckets], DIMENSIONS)
                    dense = dense[some_words]
                    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
                    vectors = pa.ListArray.from_arrays(np.arange(0, dense.size + 1, DIMENSIONS, dtype=np.int32), dense.ravel())
                    yield pa.RecordBatch.from_arrays([some.column(0).filter(pa.array(some_words)), vectors], ["id", "vector"])

        own = lowered(texts)
        return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, vector array<double>")
