"""Ingestion queries; a user is a job, an event type and phase come from the event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.labels import STAGES
from quillstone.operators import ingest, quantiles
from quillstone.plans.catalogue import query
from quillstone.sources.tables import table
from quillstone.sources.workspace import materialise
from quillstone.streaming import heartbeat, jobs

STAGE = "['parse','ocr','chunk','embed','index'][CAST(1 + event_id % 5 AS INT)]"
PHASE = "CASE WHEN event_id % 23 = 0 THEN 'fail' WHEN event_id % 3 = 0 THEN 'start' ELSE 'end' END"
LOG = f"(SELECT user_id AS job, event_id, ts, value, {STAGE} AS stage, {PHASE} AS phase, CASE WHEN {PHASE} = 'fail' THEN 'RuntimeError' END AS error_class FROM events)"
DONE = "CASE ended WHEN 'parse' THEN 25 WHEN 'ocr' THEN 45 WHEN 'chunk' THEN 65 WHEN 'embed' THEN 85 WHEN 'index' THEN 100 ELSE 0 END"


def log(spark, sf_dir) -> DataFrame:
    """The events as a stage log."""
    stage = F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 5).cast("int"))
    phase = F.expr(PHASE)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), "event_id", "ts", "value", stage.alias("stage"), phase.alias("phase"), F.when(phase == "fail", "RuntimeError").alias("error_class")
    )


@query(
    f"""WITH e AS (SELECT job, stage, max_by(value, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS v FROM {LOG} WHERE phase = 'end' GROUP BY 1, 2), w AS (SELECT *, floor(abs(v) * 100) AS f FROM e),
    -- the double as a whole number of 2**-52, and the two candidates' distances to it
    d AS (SELECT job, stage, v, f, (floor(abs(v))::HUGEINT * 4503599627370496 + ((abs(v) - floor(abs(v))) * 4503599627370496)::HUGEINT) * 200 - (2 * f + 1)::HUGEINT * 4503599627370496 AS over FROM w)
    SELECT job, stage, sign(v) * (f + CASE WHEN over > 0 OR (over = 0 AND f % 2 = 1) THEN 1 ELSE 0 END) / 100 AS ms FROM d"""
)
def stage_timings(spark, sf_dir) -> DataFrame:
    ends = log(spark, sf_dir).filter("phase = 'end'").withColumn("ms", F.col("value"))
    return ingest.stage_timings(ends).select("job", F.explode("timings").alias("stage", "ms"))


JOBS = f"""(WITH l AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS k FROM {LOG}),
    e AS (SELECT job, stage AS ended, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS k FROM {LOG} WHERE phase = 'end'),
    a AS (SELECT job, count(*) FILTER (phase = 'start' AND stage = 'parse') AS attempts, max(ts) AS seen_at FROM {LOG} GROUP BY 1)
    SELECT a.job, CASE WHEN phase = 'fail' THEN 'FAILED' WHEN phase = 'end' AND stage = 'index' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status,
    CASE WHEN NOT (phase = 'end' AND stage = 'index') THEN stage END AS current_stage, {DONE} AS progress, attempts,
    CASE WHEN phase = 'fail' THEN 'RuntimeError in stage ' || stage END AS error_message, seen_at
    FROM a JOIN l USING (job) LEFT JOIN (SELECT job, ended FROM e WHERE k = 1) e USING (job) WHERE l.k = 1)"""


@query(f"SELECT * FROM {JOBS}")
def job_latest_state(spark, sf_dir) -> DataFrame:
    return ingest.job_state(log(spark, sf_dir))


@query(f"SELECT j.job, coalesce(status, 'missing') AS status FROM (SELECT c_custkey AS job FROM customer) j LEFT JOIN {JOBS} s USING (job)")
def job_status(spark, sf_dir) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"))
    return ingest.lookup_jobs(asked, ingest.job_state(log(spark, sf_dir))).select("job", "status")


@query("SELECT stage, progress FROM (VALUES ('parse', 25), ('ocr', 45), ('chunk', 65), ('embed', 85), ('index', 100)) t(stage, progress)")
def stage_progress(spark, sf_dir) -> DataFrame:
    return log(spark, sf_dir).select("stage").distinct().withColumn("progress", ingest.stage_progress(F.col("stage")))


@query(f"SELECT job, attempts, attempts > 3 AS exhausted FROM {JOBS} WHERE attempts > 0")
def attempts(spark, sf_dir) -> DataFrame:
    return ingest.job_state(log(spark, sf_dir)).filter("attempts > 0").select("job", "attempts", (F.col("attempts") > 3).alias("exhausted"))


@query("SELECT user_id % 10 AS worker, max(ts) AS last_beat, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS down FROM events GROUP BY 1")
def worker_heartbeat(spark, sf_dir) -> DataFrame:
    beats = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("worker")).agg(F.max("ts").alias("last_beat"))
    latest = beats.agg(F.max("last_beat").alias("latest"))  # one row
    return beats.join(F.broadcast(latest), F.lit(True)).select("worker", "last_beat", F.expr("last_beat < latest - INTERVAL 1 HOUR").alias("down"))


@query(
    """WITH u AS (SELECT max(ts) - INTERVAL 10 MINUTE AS until FROM events), e AS (SELECT user_id % 10 AS worker, ts FROM events, u WHERE ts <= date_trunc('millisecond', until)),
    m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM e WINDOW w AS (PARTITION BY worker ORDER BY ts)),
    s AS (SELECT worker, min(ts) AS first_ts, max(ts) + INTERVAL 1 HOUR AS over FROM (SELECT *, sum(o) OVER (PARTITION BY worker ORDER BY ts) AS session FROM m) GROUP BY worker, session)
    SELECT worker, 'up' AS status, first_ts AS at FROM s UNION ALL SELECT worker, 'down', over FROM s, u WHERE over < date_trunc('millisecond', until)"""
)
def worker_transitions(spark, sf_dir) -> DataFrame:
    """The streaming watch, run over the beats that are there; it knows of the time up to its watermark."""
    beats = jobs.event_stream(spark, sf_dir).select((F.col("user_id") % 10).alias("worker"), "ts")
    return heartbeat.transitions_now(beats, 3600, "10 minutes").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    """WITH m AS (SELECT user_id, ts, event_id, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 86400000000 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM m) GROUP BY 1, 2"""
)
def activity_sessions(spark, sf_dir) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events"), "user_id", 86_400)


SERVICES = "(SELECT event_type AS name, avg((value > 50)::INT) < 0.5 AS up, event_type IN ('click', 'view') AS critical FROM events GROUP BY 1)"


def services(spark, sf_dir) -> DataFrame:
    """Stand-in: an event type is a service, down when half of its values are high."""
    rate = F.avg((F.col("value") > 50).cast("int"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg((rate < 0.5).alias("up")).withColumn("critical", F.col("name").isin("click", "view"))


@query(f"SELECT CASE WHEN bool_or(NOT up AND critical) THEN 'not_ready' WHEN bool_or(NOT up) THEN 'degraded' ELSE 'ready' END AS status, CASE WHEN bool_or(NOT up AND critical) THEN 503 ELSE 200 END AS http FROM {SERVICES}")
def readiness(spark, sf_dir) -> DataFrame:
    return ingest.readiness(services(spark, sf_dir))


@query(f"SELECT p_name AS name, CASE WHEN s.name IS NULL THEN 'unknown' WHEN up THEN 'up' ELSE 'down' END AS status FROM (SELECT DISTINCT event_type AS p_name FROM events UNION SELECT 'vector_store') LEFT JOIN {SERVICES} s ON name = p_name")
def service_status_left_join(spark, sf_dir) -> DataFrame:
    known = services(spark, sf_dir)
    shown = known.select("name").union(spark.range(1).select(F.lit("vector_store")))
    status = F.when(F.col("up").isNull(), "unknown").when(F.col("up"), "up").otherwise("down")
    return shown.join(known, "name", "left").select("name", status.alias("status"))


@query("SELECT user_id AS trace, round(sum(value), 4) AS total_ms, count(*) AS n_steps FROM events GROUP BY 1")
def agent_trace_total(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trace")).agg(F.round(F.sum("value"), 4).alias("total_ms"), F.count("*").alias("n_steps"))


@query("SELECT event_type AS model, count(*) AS n_calls, round(sum(value), 4) AS tokens, round(avg(value), 6) AS mean_tokens, round(quantile_cont(value, 0.5), 6) AS median_tokens FROM events GROUP BY 1")
def llm_usage(spark, sf_dir) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.count("*").alias("n_calls"), F.round(F.sum(v), 4).alias("tokens"), F.round(F.avg(v), 6).alias("mean_tokens"), F.round(F.percentile(v, 0.5), 6).alias("median_tokens")
    )


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_p95(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("SELECT event_type, count(*) AS n, true AS p50_within, true AS p95_within FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_sketch(spark, sf_dir) -> DataFrame:
    """Quantiles merged from stored daily sketches of two runs, and whether their true ranks are within
    one in a hundred rows (the SQL says they are)."""
    events = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day"), "event_id", "event_type", "value")
    runs = [materialise(quantiles.sketched(events.filter(F.col("event_id") % 2 == r), ["day", "event_type"], "value"), "sketches") for r in (0, 1)]
    whole = quantiles.merged(runs[0].unionByName(runs[1]), ["event_type"]).select("event_type", "n", quantiles.quantile(0.5).alias("q50"), quantiles.quantile(0.95).alias("q95"))
    below = events.join(whole, "event_type").groupBy("event_type", "n").agg(*[F.count_if(F.col("value") < F.col(q)).alias(f"lt_{q}") for q in ("q50", "q95")], *[F.count_if(F.col("value") <= F.col(q)).alias(f"le_{q}") for q in ("q50", "q95")])
    within = [((F.col(f"le_{q}") >= (s - 0.01) * F.col("n")) & (F.col(f"lt_{q}") <= (s + 0.01) * F.col("n"))).alias(f"p{q[1:]}_within") for q, s in (("q50", 0.5), ("q95", 0.95))]
    return below.select("event_type", "n", *within)


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2")
def rate_limit_windows(spark, sf_dir) -> DataFrame:
    return ingest.rate_windows(table(spark, sf_dir, "events"), "user_id", "1 day", 2)


REQUESTS = "(SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS tenant, props FROM events)"
BUCKET = f"""e AS MATERIALIZED (SELECT tenant, list(epoch_us(ts) ORDER BY ts, event_id) AS t, list(event_id ORDER BY ts, event_id) AS ids FROM {REQUESTS} GROUP BY 1),
    s AS (SELECT tenant, 1 AS k, 5 * 3600000000::BIGINT AS level FROM e
      UNION ALL SELECT s.tenant, k + 1, least(5 * 3600000000, level - 3600000000 + t[k + 1] - t[k]) FROM s JOIN e USING (tenant) WHERE k < len(t)),
    b AS (SELECT ids[k] AS event_id, tenant, level, level >= 3600000000 AS accepted FROM s JOIN e USING (tenant))"""


def requests(spark, sf_dir) -> DataFrame:
    """Stand-in: an event is a request; one tenant has a third of all."""
    tenant = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", "ts", tenant.alias("tenant"), "props")


@query(f"WITH RECURSIVE {BUCKET} SELECT event_id, tenant, level, accepted FROM b")
def rate_limit_bucket(spark, sf_dir) -> DataFrame:
    """A token bucket of 5 that gains a token an hour."""
    return ingest.token_bucket(requests(spark, sf_dir).drop("props"), "tenant", 5, 3600).select("event_id", "tenant", "level", "accepted")


@query(
    f"""WITH RECURSIVE {BUCKET}, r AS (SELECT event_id, CASE event_id % 50 WHEN 7 THEN props || chr(7) WHEN 9 THEN ' a ' ELSE props END AS text FROM {REQUESTS})
    SELECT event_id, CASE WHEN length(trim(text)) < 3 THEN 'too_short' WHEN length(trim(text)) > 2000 THEN 'too_long' WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{FFFD}}]') THEN 'charset' WHEN NOT accepted THEN 'rate' END AS refused FROM r JOIN b USING (event_id)"""
)
def input_guardrail(spark, sf_dir) -> DataFrame:
    """Requests refused before retrieval: length, characters, rate; a few texts are made odd."""
    text = F.when(F.col("event_id") % 50 == 7, F.concat("props", F.lit("\x07"))).when(F.col("event_id") % 50 == 9, " a ").otherwise(F.col("props"))
    judged = ingest.token_bucket(requests(spark, sf_dir), "tenant", 5, 3600)
    return judged.select("event_id", ingest.input_reason(text, F.col("accepted"), 3, 2000).alias("refused"))


@query("SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth > 1")
def duplicate_actions(spark, sf_dir) -> DataFrame:
    return ingest.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").filter("nth > 1").select("event_id", "nth")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_stage_counts(spark, sf_dir) -> DataFrame:
    """The streaming aggregation, run over what is there."""
    found = jobs.run_to_table(jobs.stage_counts(jobs.event_stream(spark, sf_dir)), "complete")
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id AS actor, event_type AS action, 'event' AS resource_type, event_id::VARCHAR AS resource_id FROM events")
def audit_projection(spark, sf_dir) -> DataFrame:
    """Ids only: neither value nor props leave the log."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.lit("event").alias("resource_type"), F.col("event_id").cast("string").alias("resource_id"))


@query("SELECT event_id, 'loc' || (event_id % 3) AS loc, 'bad' AS msg FROM events")
def validation_errors(spark, sf_dir) -> DataFrame:
    """Errors keep location and message and lose the input they quote."""
    errors = F.array(F.struct(F.concat(F.lit("loc"), (F.col("event_id") % 3).cast("string")).alias("loc"), F.lit("bad").alias("msg"), F.col("props").alias("input")))
    rows = table(spark, sf_dir, "events").select("event_id", F.transform(errors, lambda e: F.struct(e["loc"].alias("loc"), e["msg"].alias("msg"))).alias("errors"))
    return rows.select("event_id", F.inline("errors"))
