"""Structured Streaming over the event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillstone.functions.labels import STAGE_PROGRESS, STAGES
from quillstone.sources.tables import SCHEMAS
from quillstone.sources.workspace import fresh_path, settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; time becomes a zoned timestamp, as watermarks need one."""
    path = f"{sf_dir}/events.parque[t]"  # a pattern: a stream takes no single file's path
    return spark.readStream.schema(SCHEMAS["events"]).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str, numbered: bool = False) -> DataFrame:
    """Run what is there through the stream and read the last state of its result;
    ``numbered`` adds the batch of each row where batches are added."""
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, "stream-result")

    def publish(batch: DataFrame, number: int) -> None:
        # Complete mode replaces the result, other modes add their batch; a replay overwrites its own.
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, "stream-checkpoint")).trigger(availableNow=True).foreachBatch(publish).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())]) if numbered else stream.schema).parquet(out)


def stage_counts(events: DataFrame) -> DataFrame:
    """Events and summed value per day and type."""
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


SHOWN = StructType([StructField("stage", StringType()), StructField("progress", IntegerType()), StructField("attempts", IntegerType()), StructField("status", StringType())])
OUTPUT = StructType([StructField("job", LongType()), *SHOWN.fields])
STATE = "ts long, seq long, stage string, phase string, end_ts long, end_seq long, ended string, attempts int"


class JobMachine(StatefulProcessor):
    """Per job the last event, the last end and the attempts of events (seq, stage, phase, by ts if they
    have it); every batch emits the state that follows.

    Each of the three is a maximum or a count, so events are folded in as they come, in any order, and a
    job with many of them in one trigger takes no more memory.  A state that no event touches for ``hours`` goes.
    """

    def __init__(self, hours: int | None = None):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", STATE, self.hours and self.hours * 3_600_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *now, attempts = self.state.get() if self.state.exists() else (-1, -1, None, None, -1, -1, None, 0)
        last, end = tuple(now[:4]), tuple(now[4:])
        for batch in rows:
            times = batch["ts"].astype("int64") if "ts" in batch else [0] * len(batch)
            for ts, seq, stage, phase in zip(times, batch["seq"], batch["stage"], batch["phase"], strict=True):
                attempts += phase == "start" and stage == STAGES[0]
                if (ts, seq) > last[:2]:
                    last = (ts, seq, stage, phase)
                if phase == "end" and (ts, seq) > end[:2]:
                    end = (ts, seq, stage)
        self.state.update((int(last[0]), int(last[1]), *last[2:], int(end[0]), int(end[1]), end[2], attempts))
        _, _, stage, phase = last
        done = phase == "end" and stage == STAGES[-1]
        status = "SUCCEEDED" if done else "FAILED" if phase == "fail" else "RUNNING"
        progress = dict(zip(STAGES, STAGE_PROGRESS, strict=True)).get(end[2], 0)
        yield pd.DataFrame({"job": [key[0]], "stage": [None if done else stage], "progress": [progress], "attempts": [attempts], "status": [status]})

    def close(self) -> None:
        pass


def job_stream(log: DataFrame, hours: int | None = None) -> DataFrame:
    """The state machine over a stream of (job, seq, stage, phase); needs RocksDB state.

    With ``hours`` (24 in a service) states expire by processing time.  Such a stream is
    for a trigger that goes on: over what is there it would wait for expiries without end.
    """
    mode = "ProcessingTime" if hours else "None"
    return log.groupBy("job").transformWithStateInPandas(statefulProcessor=JobMachine(hours), outputStructType=OUTPUT, outputMode="Update", timeMode=mode)


def latest_states(states: DataFrame) -> DataFrame:
    """Run what is there through the state machine; the last state of each job."""
    spark = states.sparkSession
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        found = run_to_table(states, "update", numbered=True)
    return found.groupBy("job").agg(F.max_by(F.struct(*SHOWN.fieldNames()), "batch").alias("s")).select("job", "s.*")
