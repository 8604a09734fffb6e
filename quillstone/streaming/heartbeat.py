"""Workers that go silent: event-time timers say "down" when no beat comes, "up" at the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.operators.ingest import sessions
from quillstone.sources.workspace import settings
from quillstone.streaming.jobs import ROCKSDB, run_to_table

TRANSITION = "worker long, up boolean, us long"
MILLI = 1000


def merged(spans: np.ndarray, ttl: int) -> np.ndarray:
    """Spans (first, last) by time, those joined that stand ``ttl`` or less apart."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    last = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(spans[1:, 0] - last[:-1] > ttl) + 1
    return np.column_stack([spans[np.r_[0, cut], 0], last[np.r_[cut - 1, len(spans) - 1]]])


class HeartbeatWatch(StatefulProcessor):
    """Per worker: beats wait until the watermark is past them, so their order of arrival does not
    matter; then a gap of more than ``ttl`` microseconds is a time of being down.

    Beats that are no more than that apart wait as one span of time, as only the gaps between spans tell.
    The state is the last beat, whether the worker is up, and the spans that wait: of any number of
    beats as many as there are gaps.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, up boolean")
        self.waiting = handle.getListState("waiting", "first long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = np.array(list(self.waiting.get()), np.int64).reshape(-1, 2)
        for batch in rows:
            us = batch["us"].to_numpy(np.int64)  # of one Arrow batch
            spans = merged(np.concatenate([spans, np.column_stack([us, us])]), self.ttl)
        yield from self.settle(key, timerValues, spans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, timerValues, np.array(list(self.waiting.get()), np.int64).reshape(-1, 2))

    def settle(self, key, timerValues, spans: np.ndarray) -> Iterator[pd.DataFrame]:
        """The transitions up to the watermark; a timer wakes the worker when there can be another."""
        until = timerValues.getCurrentWatermarkInMs() * MILLI
        last, up = self.seen.get() if self.seen.exists() else (None, False)
        found, later = [], []
        for first, end in spans.tolist():
            if first > until:
                later.append((first, end))
                continue
            if up and first - last > self.ttl:
                found.append((False, last + self.ttl))
                up = False
            if not up:
                found.append((True, first))
            # Of a span that goes on beyond the watermark the rest waits; the worker stays up over all of it.
            last, up = min(end, until), True
            if end > until:
                later.append((until, end))
        if up and not (later and later[0][0] <= until) and last + self.ttl < until:
            found.append((False, last + self.ttl))
            up = False
        if last is not None:
            self.seen.update((last, up))
        self.waiting.put(later) if later else self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = [first if first > until else end for first, end in later[:1]] + ([last + self.ttl + MILLI] if up else [])
        if wake:
            self.handle.registerTimer(-(-min(wake) // MILLI))
        if found:
            yield pd.DataFrame({"worker": [key[0]] * len(found), "up": [up for up, _ in found], "us": [t for _, t in found]})

    def close(self) -> None:
        pass


def transition_stream(beats: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """(worker, status, at) of a stream of beats (worker, ts); needs RocksDB state."""
    timed = beats.withWatermark("ts", delay).select("worker", "ts", F.unix_micros("ts").alias("us"))
    found = timed.groupBy("worker").transformWithStateInPandas(statefulProcessor=HeartbeatWatch(ttl_seconds * 1_000_000), outputStructType=TRANSITION, outputMode="Append", timeMode="EventTime")
    return found.select("worker", F.when(F.col("up"), "up").otherwise("down").alias("status"), F.timestamp_micros("us").alias("at"))


def transitions_now(beats: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """Run what is there through the stream."""
    with settings(beats.sparkSession, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        return run_to_table(transition_stream(beats, ttl_seconds, delay), "append").select("worker", "status", "at")


def transitions(beats: DataFrame, ttl_seconds: int, until) -> DataFrame:
    """The same in batch, from sessions of beats (worker, ts) up to a time ``until`` (column)."""
    seen = beats.filter(F.col("ts") <= until)
    found = sessions(seen, "worker", ttl_seconds)
    end = F.col("last_ts") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    both = F.array(F.struct(F.lit("up").alias("status"), F.col("first_ts").alias("at")), F.struct(F.lit("down").alias("status"), end.alias("at")))
    return found.select("worker", F.inline(both)).filter((F.col("status") == "up") | (F.col("at") < until))
