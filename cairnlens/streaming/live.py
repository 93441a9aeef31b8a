"""Structured Streaming over the event log.

Every stream writes Parquet below the shared folder with its own checkpoint, so a
restart resumes where it stopped. ``run_available`` drives a stream through all data
present; a deployment starts the same query with a processing-time trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlens import schemas, vocab
from cairnlens.functions.keyed import ranked_per_key
from cairnlens.functions.predicates import recent
from cairnlens.session import shared_folder
from cairnlens.sources.sinks import append_events, stored_events
from cairnlens.streaming.state import FailureBursts, OrderedBatches, StageVisits, WorkerFreshness

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail_events(
    spark: SparkSession,
    folder: str,
    schema: str = schemas.TASK_EVENT,
    fmt: str = "parquet",
    name_filter: str = "*",
    bytes_per_trigger: int = 512 * 1024 * 1024,
) -> DataFrame:
    """The event log as a stream; files are picked up as they arrive.

    The byte limit bounds a micro-batch, and so the rows one key can bring at once to
    a stateful stream. Old history is better served by the batch operators.
    """
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("pathGlobFilter", name_filter)
        .option("maxBytesPerTrigger", bytes_per_trigger)
        .load(folder)
    )


def run_available(
    stream: DataFrame, folder: str | None = None, state_partitions: int | None = None, idle_batches: bool = True
) -> DataFrame:
    """Process everything present and return what was written.

    ``state_partitions`` fixes the number of state partitions of a new stateful
    stream; a restarted one keeps the number in its checkpoint. ``idle_batches``: whether
    batches without new rows follow, which event-time results need; timers of processing
    time would call for them without end. A stream takes a copy of the settings when it
    starts, so they are put back at once.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    usual = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{folder}/rows")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def after_sequence(events: DataFrame, sequence: int) -> DataFrame:
    """Events a reader that has seen ``sequence`` still needs; batch or stream."""
    return events.filter(F.col("event_sequence") > sequence)


def event_page(events: DataFrame, sequence: int, size: int = 100) -> DataFrame:
    """Next batch of each task's events in sequence order."""
    rows = after_sequence(events, sequence)
    return ranked_per_key(rows, ["task_id"], [F.col("event_sequence")], size, "position")


def ordered_batches(
    events: DataFrame, first: int = 1, size: int = 100, patience_seconds: int = 60
) -> DataFrame:
    """Each task's events in the order of their numbers, however they arrive.

    ``batch`` and ``position`` (from 1) count a task's events in batches of ``size``,
    whatever micro-batches brought them; ``skipped`` is how many numbers before an event
    were given up after the patience. A restarted stream goes on with the next number.
    """
    _stateful(events.sparkSession)
    rows = events.select("task_id", "event_sequence", "event_type", "created_at")
    return rows.groupBy("task_id").transformWithStateInPandas(
        OrderedBatches(first, size, patience_seconds),
        "task_id BIGINT, event_sequence BIGINT, event_type STRING, created_at TIMESTAMP, batch BIGINT,"
        " position BIGINT, skipped BIGINT, late BOOLEAN",
        "append",
        "processingTime",
    )


def deduplicated(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each (task, sequence) once, however often it is delivered within the delay."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(
        ["task_id", "event_sequence"]
    )


def risk_alerts(events: DataFrame) -> DataFrame:
    return events.filter(F.col("severity").isin("warning", "error"))


def split_late(
    events: DataFrame, time_column: str, delay_seconds: int, folder: str
) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of everything present, each event in one of the two.

    The rule is that of a watermark: a micro-batch's rows are late if they are older than
    the newest row of all batches before, less the delay. Both outputs and the newest
    time of each batch are kept by batch, so a batch that is run again after a failure
    changes nothing. A stateful stream with the same delay that reads the rows in time
    (below ``folder``/in_time) drops none of them.
    """
    spark, schema = events.sparkSession, events.schema
    seen = f"{folder}/newest"

    def split(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        before = stored_events(own, seen, "newest TIMESTAMP, number BIGINT").filter(F.col("number") < number)
        newest = before.agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else (
            F.col(time_column) < F.lit(newest) - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS")
        )
        late = F.coalesce(late, F.lit(False))
        name = f"{number:012d}"
        append_events(rows.filter(late), f"{folder}/late", name)
        append_events(rows.filter(~late), f"{folder}/in_time", name)
        append_events(rows.agg(F.max(time_column).alias("newest")).withColumn("number", F.lit(number).cast("bigint")), seen, name)

    query = (
        events.writeStream.foreachBatch(split)
        .option("checkpointLocation", f"{folder}/split")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stored_events(spark, f"{folder}/in_time", schema), stored_events(spark, f"{folder}/late", schema)


def _stateful(spark: SparkSession) -> None:
    if spark.conf.get(STATE_STORE, "") != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)


def stage_visits(events: DataFrame, as_of) -> DataFrame:
    """Closed stage visits as they end, from the recent part of the log."""
    _stateful(events.sparkSession)
    staged = events.filter(F.col("stage").isNotNull() & recent("created_at", as_of)).select(
        "task_id", "event_sequence", F.upper("stage").alias("stage"), "created_at"
    )
    # events later than the recent window behind the newest ones are out of scope anyway
    timed = staged.withWatermark("created_at", f"{vocab.RECENT_HOURS} hours")
    visits = timed.groupBy("task_id").transformWithStateInPandas(
        StageVisits(),
        "task_id BIGINT, stage STRING, started_at TIMESTAMP, completed_at TIMESTAMP",
        "append",
        "eventTime",
    )
    return visits.filter(
        F.col("stage").isin(vocab.STAGE_NAMES) & (F.col("completed_at") >= F.col("started_at"))
    )


def failure_bursts(
    attempts: DataFrame,
    threshold: int = vocab.BURST_THRESHOLD,
    window_seconds: int = vocab.BURST_WINDOW_SECONDS,
    block_seconds: int = vocab.BURST_BLOCK_SECONDS,
    delay: str = "1 hour",
) -> DataFrame:
    """Blocks started by clients whose failures reach the threshold in one window.

    ``attempts`` holds (client, attempt_id, attempted_at, failed).
    """
    _stateful(attempts.sparkSession)
    timed = attempts.withWatermark("attempted_at", delay)
    return timed.groupBy("client").transformWithStateInPandas(
        FailureBursts(threshold, window_seconds, block_seconds),
        "client BIGINT, window_started_at TIMESTAMP, blocked_at TIMESTAMP, "
        "blocked_until TIMESTAMP, failure_count BIGINT",
        "append",
        "eventTime",
    )


def stale_workers(
    heartbeats: DataFrame, max_age_seconds: int = vocab.HEARTBEAT_SECONDS, delay: str | None = None
) -> DataFrame:
    """Workers that report themselves stopped or whose last heartbeat grew too old.

    ``delay`` is how far a worker may lag behind the newest heartbeat of any other and
    still be heard; by default the allowed age and half of it again for clock skew. A
    shorter one would drop a lagging worker's heartbeats instead of reporting it.
    """
    delay = delay or f"{max_age_seconds + max_age_seconds // 2} seconds"
    _stateful(heartbeats.sparkSession)
    beats = heartbeats.withWatermark("last_checked_at", delay)
    return beats.groupBy("worker_owner").transformWithStateInPandas(
        WorkerFreshness(max_age_seconds),
        "worker_owner STRING, last_checked_at TIMESTAMP, reason STRING",
        "append",
        "eventTime",
    )
