"""Streams against their batch answers, with input out of order over several triggers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import ingest
from quillstone.streaming import heartbeat

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.mark.parametrize("seed", [1, 2])
def test_heartbeats_in_any_order_give_the_batch_answer(spark, tmp_path, seed):
    rng = random.Random(seed)
    seconds = sorted(rng.uniform(0, 40_000) for _ in range(400))
    seconds = [s for s in seconds if not 9000 < s < 14_000 and not 20_000 < s < 21_000]  # silence of all workers
    beats = [(w, s) for s in seconds for w in [rng.choice([1, 1, 1, 2, 3])]]
    beats += [(4, 100.0), (4, 100.0 + 1800), (4, 100.0 + 3600.000001)]  # exactly the limit apart, then just over
    arrival = sorted(beats, key=lambda b: b[1] + rng.uniform(0, 1500))  # late by less than the delay
    size = len(arrival) // 6 + 1
    rows = [(w, START + datetime.timedelta(seconds=s)) for w, s in arrival]
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], "worker long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/beats")
    stream = spark.readStream.schema("worker long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/beats")
    got = sorted(tuple(r) for r in heartbeat.transitions_now(stream, 1800, "30 minutes").collect())
    every = spark.read.parquet(f"{tmp_path}/beats")
    until = every.agg(F.max("ts")).first()[0] - datetime.timedelta(minutes=30)
    until = until.replace(microsecond=until.microsecond // 1000 * 1000)
    want = sorted(tuple(r) for r in heartbeat.transitions(every, 1800, F.lit(until)).collect())
    assert got == want and {"up", "down"} == {s for _, s, _ in got}
    assert [s for w, s, _ in got if w == 4][:2] != ["up", "up"]


def test_sessions_at_the_gap(spark):
    times = [0.0, 10.0, 20.000001, 50.0, 60.0]
    rows = [("a", START + datetime.timedelta(seconds=s)) for s in times] + [("b", START)] * 3
    found = ingest.sessions(spark.createDataFrame(rows, "k string, ts timestamp"), "k", 10)
    assert sorted((r["k"], r["session"], r["n"]) for r in found.collect()) == [("a", 1, 2), ("a", 2, 1), ("a", 3, 2), ("b", 1, 3)]
