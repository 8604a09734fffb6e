"""Repeats on a host: hashes cross packed, texts not at all."""

import numpy as np
import pyarrow as pa

from quillstone.llm import html_extract


def test_texts_are_not_shuffled(spark):
    rows = [(i, "http://b.example/", f"<nav>one two three four five six seven eight nine ten</nav><article>own {i}</article>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    with html_extract.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        got = html_extract.main_texts(pages)
        plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
        exchanges = [i for i, line in enumerate(plan) if "Exchange" in line]
        assert len(exchanges) == 1 and not any("blocks" in line for line in plan[exchanges[0] :])
        assert {r["n_repeated"] for r in got.collect()} == {11}


def test_entries_come_back_from_their_packing():
    rng = np.random.default_rng(7)
    e = rng.integers(0, 1 << 63, (5, 50_000), np.uint64) << np.uint64(1)
    e[0] >>= np.uint64(24)
    e[0] <<= np.uint64(24)
    e[1] &= np.uint64(7)
    e[2] = (np.uint64(3) << np.uint64(42)) + (e[2] & np.uint64(0xFFF))
    e[3] = np.where(e[3] % np.uint64(9) == 0, np.int64(-5).astype(np.uint64), np.uint64(0))
    e[4] &= np.uint64(0x3FF)
    batch = html_extract.packed([e[:, :20_000], e[:, 20_000:]], 4)
    assert batch.num_rows == 16 and batch.nbytes < 9 * e.shape[1]
    key, more, row, back, start = html_extract.unpacked(pa.Table.from_batches([batch]))
    assert sorted(zip(key, more, row, back, start)) == sorted(zip(e[0], e[1], *e[2:].astype(np.int64)))
