"""Blocks of vectors: ties, and how many are in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import retrieval


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_nearest_in_block_breaks_ties_by_id(monkeypatch, held):
    monkeypatch.setattr(retrieval, "HELD", held)
    own, x = np.array([7, 3, 9, 1, 5, 11]), np.array([[1.0, 0], [1, 0], [0, 1], [1, 0], [0.6, 0.8], [np.nan, 0]])
    got = retrieval.nearest_in_block(np.array([1, 20]), np.array([[1.0, 0], [0, 1]]), own, x, 2, True).to_pylist()
    assert [(r["query"], r["id"], r["similarity"]) for r in got] == [(1, 3, 1.0), (1, 7, 1.0), (20, 9, 1.0), (20, 5, 0.8)]


def test_few_pairs_of_blocks_are_in_memory(spark):
    vectors = spark.range(3000).select("id", F.expr("transform(sequence(1, 64), i -> cast(sin(id * i) as float))").alias("vector"))
    pairs = retrieval.packed(vectors, 300, "own").crossJoin(retrieval.packed(vectors, 300, "asked")).select("asked", "own").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    with retrieval.settings(spark, retrieval.PAIR_BATCH):
        most = max(r["n"] for r in pairs.mapInArrow(sizes, "n long").collect())
    assert most < 60  # of 100 pairs
