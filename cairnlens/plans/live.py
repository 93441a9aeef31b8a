"""Queries: streams driven through the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlens import schemas, vocab
from cairnlens.functions.text import mean_millis, micros_between
from cairnlens.plans.metrics import EVENTS_AS_OF, STAGE_DURATIONS
from cairnlens.plans.registry import query
from cairnlens.session import shared_folder
from cairnlens.streaming import live


def _event_stream(d):
    """The events table as a live source, in the shape of the event log."""
    raw = live.tail_events(
        d.spark, d.folder, schemas.TABLE_SCHEMAS["events"], name_filter="events.parquet"
    )
    stage = vocab.mapping_column(
        F.col("event_type"),
        [("view", "validating"), ("click", "IDENTIFYING"), ("signup", "EXTRACTING"),
         ("purchase", "SCANNING")],
    )
    return raw.select(
        F.col("user_id").alias("task_id"),
        F.col("event_id").alias("event_sequence"),
        "event_type",
        stage.alias("stage"),
        F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warning")
        .otherwise("info").alias("severity"),
        F.col("ts").alias("created_at"),
    )


def _run(d, stream, idle_batches=True):
    # one state partition per core of the cluster
    return live.run_available(
        stream, state_partitions=d.spark.sparkContext.defaultParallelism, idle_batches=idle_batches
    )


@query("event_tail", """
SELECT task_id, event_sequence, position FROM (
  SELECT task_id, event_sequence,
         row_number() OVER (PARTITION BY task_id ORDER BY event_sequence) AS position
  FROM task_events WHERE event_sequence > 200) WHERE position <= 20""")
def _(d):
    return live.event_page(d.task_events, 200, 20).select("task_id", "event_sequence", "position")


@query("event_tail_stream", """
SELECT task_id, event_sequence, event_type FROM task_events WHERE event_sequence > 200""")
def _(d):
    stream = live.after_sequence(_event_stream(d), 200)
    return live.run_available(stream.select("task_id", "event_sequence", "event_type"))


@query("event_tail_batches", """
SELECT event_id % 97 AS task_id, event_id // 97 + 1 AS event_sequence, event_type,
       event_id // 97 // 100 AS batch, event_id // 97 % 100 + 1 AS position, 0::BIGINT AS skipped, false AS late
FROM events""")
def _(d):
    """Event ids are dense, so their quotients number the events of each remainder."""
    raw = _event_stream(d)
    dense = raw.withColumn("task_id", F.col("event_sequence") % 97).withColumn(
        "event_sequence", F.expr("event_sequence div 97 + 1")
    )
    return _run(d, live.ordered_batches(dense), idle_batches=False).drop("created_at")


@query("event_dedupe", "SELECT task_id, event_sequence FROM task_events")
def _(d):
    # every event is delivered twice
    twice = _event_stream(d).unionByName(_event_stream(d))
    fresh = live.deduplicated(twice.select("task_id", "event_sequence", "created_at"), "60 days")
    return _run(d, fresh.select("task_id", "event_sequence"))


@query("risk_alert_stream", """
SELECT task_id, event_sequence, severity FROM task_events
WHERE severity IN ('warning', 'error')""")
def _(d):
    alerts = live.risk_alerts(_event_stream(d))
    return live.run_available(alerts.select("task_id", "event_sequence", "severity"))


@query("late_events", """
WITH cut AS (SELECT max(created_at) FILTER (event_sequence % 3 <> 0) AS newest FROM task_events)
SELECT task_id, event_sequence, event_sequence % 3 = 0 AND created_at < newest - INTERVAL 10 DAY AS late
FROM task_events, cut""")
def _(d):
    """Two thirds of the log, then the rest, of which old events are late."""
    folder = shared_folder(d.spark)
    log = d.task_events.select("task_id", "event_sequence", "created_at")
    for rest in ("event_sequence % 3 <> 0", "event_sequence % 3 = 0"):
        log.filter(rest).write.mode("append").parquet(f"{folder}/log")
        stream = live.tail_events(d.spark, f"{folder}/log", log.schema)
        in_time, late = live.split_late(stream, "created_at", 10 * 86400, folder)
    return in_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))).drop("created_at")


@query("stage_duration_stream", STAGE_DURATIONS)
def _(d):
    visits = _run(d, live.stage_visits(_event_stream(d), EVENTS_AS_OF))
    pairs = [(name, at) for at, name in enumerate(vocab.STAGE_NAMES, start=1)]
    return (
        visits.groupBy("stage")
        .agg(
            F.count("*").alias("sample_count"),
            mean_millis(micros_between("started_at", "completed_at")).alias("average_duration_ms"),
        )
        .withColumn("stage_order", vocab.mapping_column(F.col("stage"), pairs))
    )


BURST = {"threshold": 3, "window_seconds": 10 * 86400, "block_seconds": 3 * 86400}


@query("failure_burst", """
WITH RECURSIVE attempts AS (
  SELECT user_id AS client, ts, event_type = 'error' AS failed,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
walk AS (
  SELECT client, k, ts AS started, CASE WHEN failed THEN 1 ELSE 0 END AS failures,
         CAST(NULL AS TIMESTAMP) AS blocked, false AS burst, ts FROM attempts WHERE k = 1
  UNION ALL
  SELECT client, ak, CASE WHEN limited THEN started WHEN fresh THEN ats ELSE started END,
    CASE WHEN limited THEN failures
         ELSE CASE WHEN fresh THEN 0 ELSE failures END + CASE WHEN failed THEN 1 ELSE 0 END END,
    CASE WHEN limited THEN blocked
         WHEN failed AND CASE WHEN fresh THEN 0 ELSE failures END + 1 >= 3
         THEN ats + INTERVAL 3 DAY END,
    NOT limited AND failed AND CASE WHEN fresh THEN 0 ELSE failures END + 1 >= 3, ats
  FROM (SELECT w.client, w.started, w.failures, w.blocked, a.ts AS ats, a.failed, a.k AS ak,
          w.blocked IS NOT NULL AND w.blocked > a.ts AS limited,
          w.blocked IS NOT NULL OR w.started + INTERVAL 10 DAY <= a.ts AS fresh
        FROM walk w JOIN attempts a ON a.client = w.client AND a.k = w.k + 1))
SELECT client, started AS window_started_at, ts AS blocked_at, blocked AS blocked_until,
       failures AS failure_count FROM walk WHERE burst""")
def _(d):
    attempts = _event_stream(d).select(
        F.col("task_id").alias("client"),
        F.col("event_sequence").alias("attempt_id"),
        F.col("created_at").alias("attempted_at"),
        (F.col("event_type") == "error").alias("failed"),
    )
    return _run(d, live.failure_bursts(attempts, **BURST))


@query("stale_worker_stream", """
SELECT worker_owner, last_checked_at, CASE WHEN status <> 'ready' THEN 'stopped' ELSE 'stale' END
  AS reason
FROM worker_readiness
WHERE status <> 'ready' OR epoch_ms(last_checked_at) + 45000
      <= (SELECT epoch_ms(max(last_checked_at)) FROM worker_readiness)""")
def _(d):
    raw = live.tail_events(
        d.spark, d.folder, schemas.TABLE_SCHEMAS["supplier"], name_filter="supplier.parquet"
    )
    age = F.expr("INTERVAL 1 SECOND * (s_suppkey * 7 % 90)")
    beats = raw.select(
        F.col("s_name").alias("worker_owner"),
        F.when(F.col("s_acctbal") < 0, "stopped").otherwise("ready").alias("status"),
        (F.lit(EVENTS_AS_OF).cast("timestamp") - age).alias("last_checked_at"),
    )
    # one heartbeat per worker and one batch: nothing can be late, so no lag is waited for
    return _run(d, live.stale_workers(beats, delay="0 seconds"))
