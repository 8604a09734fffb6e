"""Answers at other sizes than the given tables', and what a task holds there."""

import numpy as np

from quillstone.plans import catalogue


def test_index_recall_counts_as_its_sql_where_ids_start_at_zero(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).tolist(), i % 2) for i in range(101)]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    row = catalogue.queries()["index_recall"](spark, f"file://{tmp_path}").first()
    assert (row["n_queries"], row["enough"]) == (1, True)  # 101 // 100; the ids 0 and 100 ask
