"""Ingestion as an event log: job state is derived, never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.labels import STAGE_PROGRESS, STAGES, lookup
from quillstone.operators.ordering import ranked
from quillstone.operators.service import half_even
from quillstone.sources.workspace import materialise


def stage_progress(stage: Column) -> Column:
    return lookup(stage, STAGES, STAGE_PROGRESS)


def stage_timings(ends: DataFrame) -> DataFrame:
    """Stage ends (job, stage, ms) as a map of stage to its last duration, 2 decimals of the binary number."""
    last = ends.groupBy("job", "stage").agg(F.max_by("ms", F.struct("ts", "event_id")).alias("ms")).withColumn("ms", half_even(F.col("ms")))
    return last.groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("timings"))


def job_state(log: DataFrame) -> DataFrame:
    """One row per job of the log (job, event_id, ts, stage, phase, error_class).

    A start opens an attempt at the first stage and clears only the job's error; ends
    move progress on; a failure keeps stage and progress; the last stage's end clears
    the stage.  Progress is that of the last end: a retry does not reset it.
    """
    at = F.struct("ts", "event_id")
    last_end = F.col("phase") == "end"
    state = log.groupBy("job").agg(
        F.max_by(F.struct("stage", "phase", "error_class"), at).alias("last"),
        F.max_by(F.when(last_end, F.col("stage")), F.when(last_end, at)).alias("ended"),
        F.count_if((F.col("phase") == "start") & (F.col("stage") == STAGES[0])).alias("attempts"),
        F.max("ts").alias("seen_at"),
    )
    done = (F.col("last.phase") == "end") & (F.col("last.stage") == STAGES[-1])
    failed = F.col("last.phase") == "fail"
    return state.select(
        "job",
        F.when(failed, "FAILED").when(done, "SUCCEEDED").otherwise("RUNNING").alias("status"),
        F.when(~done, F.col("last.stage")).alias("current_stage"),
        F.coalesce(stage_progress(F.col("ended")), F.lit(0)).alias("progress"),
        "attempts",
        F.when(failed, F.concat(F.col("last.error_class"), F.lit(" in stage "), F.col("last.stage"))).alias("error_message"),
        "seen_at",
    )


def lookup_jobs(asked: DataFrame, state: DataFrame) -> DataFrame:
    """State of the asked jobs; a job without events is "missing"."""
    found = asked.join(state, "job", "left")
    return found.withColumn("status", F.coalesce("status", F.lit("missing")))


def readiness(services: DataFrame) -> DataFrame:
    """(name, up, critical) to one row: status, http."""
    down = services.agg(
        F.coalesce(F.bool_or(~F.col("up") & F.col("critical")), F.lit(False)).alias("critical"),
        F.coalesce(F.bool_or(~F.col("up")), F.lit(False)).alias("some"),
    )
    status = F.when(F.col("critical"), "not_ready").when(F.col("some"), "degraded").otherwise("ready")
    return down.select(status.alias("status"), F.when(F.col("critical"), 503).otherwise(200).alias("http"))


def sessions(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Heartbeat gaps: events of a key (ts) further apart than the gap open a new session.

    Spark merges a task's events into sessions before the shuffle, so a key with a third of all events
    is shuffled as its sessions; only these are numbered.
    """
    kind = dict(events.dtypes)["ts"]
    timed = events.select(F.col(key), F.col("ts").cast("timestamp").alias("ts"))
    window = F.session_window("ts", f"{gap_seconds} seconds").alias("w")  # an event exactly the gap later still belongs
    found = timed.groupBy(key, window).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("first_ts")).cast("long")
    return found.select(key, number.alias("session"), F.col("first_ts").cast(kind).alias("first_ts"), F.col("last_ts").cast(kind).alias("last_ts"), "n")


def rate_windows(events: DataFrame, tenant: str, width: str, limit: int) -> DataFrame:
    """Requests per tenant and tumbling window, and those over the limit."""
    counted = events.groupBy(tenant, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(tenant, F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def token_bucket(events: DataFrame, tenant: str, capacity: int, refill_seconds: float) -> DataFrame:
    """events (event_id, ts, the tenant) with level (microseconds of refill) and accepted.

    A bucket is full at first, gains a token in ``refill_seconds`` and never holds more than
    ``capacity``; every request takes one, refused ones too, so hammering keeps a tenant out.
    Refill, clamp and take is x -> min(x + a, b), and such steps compose to one of the same form.
    A tenant's log is dealt into ranges, each folded to its count and least offset, and what comes
    before a range is composed from those: a tenant with a third of all events is many tasks' work.
    """
    refill = round(refill_seconds * 1_000_000)
    us = F.unix_micros(F.col("ts").cast("timestamp")) if dict(events.dtypes)["ts"] == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    dealt = events.withColumn("us", us).repartitionByRange(tenant, "us", "event_id").withColumn("range", F.spark_partition_id())
    dealt = materialise(dealt, "requests")
    within = Window.partitionBy(tenant, "range").orderBy("us", "event_id")
    # The level before request i is t(i) - i * refill plus the least of capacity * refill - t(j) + j * refill up to i.
    own = dealt.withColumn("i", F.row_number().over(within).cast("long")).withColumn("offset", F.col("i") * refill - F.col("us"))
    own = own.withColumn("least", F.min("offset").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    folded = own.groupBy(tenant, "range").agg(F.max("i").alias("n"), F.min("offset").alias("least"))
    earlier = Window.partitionBy(tenant).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    folded = folded.withColumn("carried", F.min(F.col("least") + F.col("before") * refill).over(earlier))
    carry = folded.select(F.col(tenant).alias("of"), F.col("range").alias("at"), "before", "carried")
    joined = own.join(carry, F.expr(f"{tenant} <=> of AND range = at"))
    least = F.least("carried", F.col("least") + F.col("before") * refill)  # a null counts for nothing
    level = F.lit(capacity * refill) + least + F.col("us") - (F.col("before") + F.col("i")) * refill
    return joined.withColumn("level", level).withColumn("accepted", level >= refill).select(*events.columns, "level", "accepted")


def input_reason(text: Column, accepted: Column, shortest: int, longest: int) -> Column:
    """Why a request is refused before anything is retrieved, null for one that is taken; the first reason counts."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    odd = text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFD]")
    return F.when(size < shortest, "too_short").when(size > longest, "too_long").when(odd, "charset").when(~accepted, "rate")


#: Equal actions that one task puts in order; more of them are ranked in ranges.
HOT = 200_000


def first_of(actions: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Actions with their number (nth) among equals; all but number 1 are duplicates.

    A count, added up before the shuffle, finds the keys repeated over ``HOT`` times; only their
    actions are put in ranges, so an action repeated without end is no one task's work.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    hot = actions.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.count("*").alias("n_equal")).filter(F.col("n_equal") > HOT).drop("n_equal")
    hot = materialise(hot, "hot-actions")
    if hot.isEmpty():
        return actions.withColumn("nth", nth)
    same = F.expr(" AND ".join(f"{k} <=> of_{k}" for k in keys))
    many = ranked(actions.join(hot, same, "left_semi").withColumn("group_key", F.struct(*keys)), "group_key", list(order), F.lit(1), "nth")
    return actions.join(hot, same, "left_anti").withColumn("nth", nth).unionByName(many.withColumn("nth", F.col("nth") + 1).drop("group_key"))
