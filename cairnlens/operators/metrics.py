"""Operational metrics over tasks, jobs, events and analyzer runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions import chunks
from cairnlens.functions.keyed import first_per_key
from cairnlens.functions.predicates import heartbeat_fresh, instant, needs_attention, recent
from cairnlens.functions.text import mean_millis, micros_between, trim_space


def live_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("deleted_at").isNull())


def task_counts(tasks: DataFrame) -> DataFrame:
    """Live tasks per status, zero for a status without tasks."""
    counts = live_tasks(tasks).groupBy("status").agg(F.count("*").alias("n"))
    rows = [
        (name, name in vocab.ACTIVE_TASK_STATUSES, name == "QUEUED")
        for name in vocab.TASK_STATUSES
    ]
    known = vocab.frame(tasks.sparkSession, rows, "status, is_active, is_queued")
    # the counts have at most one row per status, so either side may be broadcast
    return known.join(counts, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("task_count"), "is_active", "is_queued"
    )


def task_totals(tasks: DataFrame) -> DataFrame:
    return live_tasks(tasks).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin(vocab.ACTIVE_TASK_STATUSES)).alias("active"),
        F.count_if(F.col("status") == "QUEUED").alias("queued"),
    )


def _leased(as_of):
    return (
        F.col("status").isin(vocab.LEASED_JOB_STATUSES)
        & F.col("lease_owner").isNotNull()
        & (F.col("lease_until") > instant(as_of))
    )


def _jobs_of_live_tasks(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    live = live_tasks(tasks).select(F.col("id").alias("task_id"))
    return jobs.join(live, "task_id", "left_semi")


def queue_summary(jobs: DataFrame, tasks: DataFrame, as_of) -> DataFrame:
    """Queue depth, live leases, their distinct owners and heartbeat range."""
    leased = _leased(as_of)
    return _jobs_of_live_tasks(jobs, tasks).agg(
        F.count_if(F.col("status") == "queued").alias("depth"),
        F.count_if(leased).alias("leases"),
        F.count_distinct(F.when(leased, F.col("lease_owner"))).alias("owners"),
        F.min(F.when(leased, F.col("heartbeat_at"))).alias("oldest_heartbeat"),
        F.max(F.when(leased, F.col("heartbeat_at"))).alias("latest_heartbeat"),
    )


def leases_by_kind(jobs: DataFrame, tasks: DataFrame, as_of) -> DataFrame:
    counts = (
        _jobs_of_live_tasks(jobs.filter(_leased(as_of)), tasks)
        .groupBy("kind")
        .agg(F.count("*").alias("n"))
    )
    kinds = vocab.frame(jobs.sparkSession, [(k,) for k in vocab.JOB_KINDS], "kind")
    return kinds.join(counts, "kind", "left").select(
        "kind", F.coalesce("n", F.lit(0)).alias("lease_count")
    )


def stage_transitions(
    events: DataFrame, as_of, span: int = chunks.DEFAULT_SPAN
) -> DataFrame:
    """First event of each stage visit, per task in sequence order.

    Events without a stage and events before the recent window are dropped first,
    so they neither end a stage nor hide its start.
    """
    staged = (
        events.filter(F.col("stage").isNotNull() & recent("created_at", as_of))
        .select("task_id", "event_sequence", F.upper("stage").alias("stage"), "created_at")
    )
    marked = chunks.lag_value(
        staged, ["task_id"], "event_sequence", "stage", "previous_stage", span
    )
    return marked.filter(
        F.col("previous_stage").isNull() | (F.col("previous_stage") != F.col("stage"))
    )


def stage_intervals(events: DataFrame, as_of, span: int = chunks.DEFAULT_SPAN) -> DataFrame:
    """Closed visits of the listed stages; a visit may end at an unlisted stage."""
    timed = chunks.lead_value(
        stage_transitions(events, as_of, span).drop("previous_stage"),
        ["task_id"],
        "event_sequence",
        "created_at",
        "completed_at",
        span,
    )
    return timed.filter(
        (F.col("completed_at") >= F.col("created_at"))
        & F.col("stage").isin(vocab.STAGE_NAMES)
    ).withColumnRenamed("created_at", "started_at")


def stage_durations(events: DataFrame, as_of, span: int = chunks.DEFAULT_SPAN) -> DataFrame:
    """Closed visits per stage and their mean length, with the pipeline position."""
    spans = micros_between("started_at", "completed_at")
    pairs = [(name, at) for at, name in enumerate(vocab.STAGE_NAMES, start=1)]
    return (
        stage_intervals(events, as_of, span)
        .groupBy("stage")
        .agg(F.count("*").alias("sample_count"), mean_millis(spans).alias("average_duration_ms"))
        .withColumn("stage_order", vocab.mapping_column(F.col("stage"), pairs))
    )


def analyzer_failure_rates(runs: DataFrame, as_of) -> DataFrame:
    """Failed share of finished recent runs of each analyzer, in basis points."""
    failed = F.count_if(F.col("status").isin(vocab.FAILED_RUN_STATUSES))
    return (
        runs.filter(
            F.col("status").isin(vocab.TERMINAL_RUN_STATUSES) & recent("created_at", as_of)
        )
        .groupBy("analyzer_name")
        .agg(F.count("*").alias("total_runs"), failed.alias("failed_runs"))
        .withColumn(
            "failure_rate_basis_points",
            F.floor((F.col("failed_runs") * 20000 + F.col("total_runs")) / (F.col("total_runs") * 2))
            .cast("bigint"),
        )
    )


def observed_analyzers(runs: DataFrame) -> DataFrame:
    """Newest run per analyzer, by an aggregate that meets few rows of a name a task."""
    named = runs.withColumn("analyzer_key", F.lower(trim_space("analyzer_name"))).filter("analyzer_key <> ''")
    run = F.struct("id", "analyzer_name", "analyzer_version", "created_at")
    newest = F.max_by(run, F.struct("created_at", "id")).alias("run")
    return named.groupBy("analyzer_key").agg(newest).select("run.*", "analyzer_key")


def latest_bundle(bundles: DataFrame) -> DataFrame:
    return bundles.orderBy(F.desc("registered_at"), F.desc("id")).limit(1)


def database_age_days(bundles: DataFrame, as_of) -> DataFrame:
    """Whole days since the newest bundle was generated, 0 if that lies ahead."""
    micros = F.unix_micros(instant(as_of)) - F.unix_micros("generated_at")
    days = F.floor(micros / F.lit(86_400_000_000)).cast("bigint")
    return latest_bundle(bundles).select(
        "id", "version", F.greatest(days, F.lit(0)).alias("age_days")
    )


def overview(tasks: DataFrame) -> DataFrame:
    """Counts over the eight newest tasks."""
    newest = live_tasks(tasks).orderBy(F.desc("created_at"), F.desc("id")).limit(8)
    status = F.upper("status")
    return newest.agg(
        F.count("*").alias("total"),
        F.count_if(status.isin(vocab.OVERVIEW_ACTIVE_STATUSES)).alias("active"),
        F.count_if(needs_attention()).alias("attention"),
        F.count_if(status == "QUEUED").alias("queued"),
    )


def attention_tasks(tasks: DataFrame) -> DataFrame:
    status = F.upper("status")
    return tasks.filter(needs_attention()).select(
        "id",
        "status",
        "risk_level",
        status.isin(vocab.OVERVIEW_ACTIVE_STATUSES).alias("is_active"),
        (status == "QUEUED").alias("is_queued"),
    )


def storage_usage(mounts: DataFrame) -> DataFrame:
    """Used share, its level, and whether free space nears the required minimum."""
    used = F.col("total_bytes") - F.col("free_bytes")
    percent = F.when(F.col("total_bytes") == 0, 100).otherwise(
        F.floor(used * 100 / F.nullif("total_bytes", F.lit(0)) + 0.5)
    )
    level = (
        F.when(F.col("used_percent") >= vocab.STORAGE_CRITICAL_PERCENT, "critical")
        .when(F.col("used_percent") >= vocab.STORAGE_WARNING_PERCENT, "warning")
        .otherwise("normal")
    )
    return (
        mounts.withColumn("used_percent", percent.cast("bigint"))
        .withColumn("level", level)
        .withColumn("near_low_water", F.col("free_bytes") < F.col("minimum_free_bytes") * 2)
    )


def readiness_fresh(workers: DataFrame, as_of) -> DataFrame:
    return workers.filter(heartbeat_fresh(as_of))


def stale_workers(workers: DataFrame, as_of) -> DataFrame:
    return workers.filter(~heartbeat_fresh(as_of))


def analyzer_status(
    registrations: DataFrame, workers: DataFrame, observed: DataFrame, as_of
) -> DataFrame:
    """State of every registered analyzer, then past ones without a registration.

    Ready needs a fresh heartbeat of the registered version from each required
    worker kind.
    """
    key = lambda column: F.lower(trim_space(column))
    beats = workers.withColumn("analyzer_key", key("analyzer_name")).withColumn(
        "fresh", heartbeat_fresh(as_of)
    )
    wanted = registrations.select(
        key("name").alias("analyzer_key"), "name", "version", "scope",
        F.split("required_kinds", ",").alias("required"),
    )
    same = F.col("fresh") & (
        (F.col("version") == "") | (F.col("analyzer_version") == F.col("version"))
    )
    joined = wanted.join(beats, "analyzer_key", "left")
    # collect_set keeps at most one entry per worker kind, a closed vocabulary
    live = joined.groupBy("analyzer_key", "name", "scope", "required").agg(
        F.count_if(same).alias("ready_workers"),
        F.array_sort(F.collect_set(F.when(same, F.col("worker_kind")))).alias("ready"),
        F.coalesce(F.bool_or(F.col("fresh") & ~same), F.lit(False)).alias("mismatch"),
        F.max("last_checked_at").alias("last_checked_at"),
    )
    runs = observed.select("analyzer_key", F.col("created_at").alias("last_run_at"))
    missing = F.array_sort(F.array_except("required", "ready"))
    registered = live.join(runs, "analyzer_key", "left").select(
        "name",
        "scope",
        F.when(~F.col("mismatch") & (F.size(missing) == 0) & (F.col("ready_workers") > 0), "available")
        .otherwise("unavailable").alias("status"),
        "ready_workers",
        F.array_join("ready", ",").alias("ready_kinds"),
        F.array_join(missing, ",").alias("missing_kinds"),
        "mismatch",
        "last_checked_at",
        "last_run_at",
    )
    past = observed.join(wanted.select("analyzer_key"), "analyzer_key", "left_anti").select(
        F.col("analyzer_name").alias("name"),
        F.lit("historical").alias("scope"),
        F.lit("unavailable").alias("status"),
        F.lit(0).cast("bigint").alias("ready_workers"),
        F.lit("").alias("ready_kinds"),
        F.lit("").alias("missing_kinds"),
        F.lit(False).alias("mismatch"),
        F.lit(None).cast("timestamp").alias("last_checked_at"),
        F.col("created_at").alias("last_run_at"),
    )
    return registered.unionByName(past)


def required_minus_ready(registrations: DataFrame, workers: DataFrame, as_of) -> DataFrame:
    """Worker kinds each registered analyzer still lacks a fresh heartbeat from."""
    ready = (
        readiness_fresh(workers, as_of)
        .select(F.lower(trim_space("analyzer_name")).alias("analyzer_key"), "worker_kind")
        .distinct()
        .groupBy("analyzer_key")
        # at most one entry per worker kind, a closed vocabulary
        .agg(F.collect_list("worker_kind").alias("_ready"))
    )
    wanted = registrations.withColumn("analyzer_key", F.lower(trim_space("name")))
    missing = F.array_except(
        F.split("required_kinds", ","), F.coalesce("_ready", F.array().cast("array<string>"))
    )
    return wanted.join(ready, "analyzer_key", "left").select(
        "name", F.array_sort(missing).alias("missing_kinds")
    )


def last_sequence(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Next free event sequence of every task."""
    highest = events.groupBy("task_id").agg(F.max("event_sequence").alias("highest"))
    return tasks.join(highest, tasks["id"] == highest["task_id"], "left").select(
        F.col("id").alias("task_id"),
        (F.coalesce("highest", F.lit(0)) + 1).alias("next_sequence"),
    )


def attempt_high_water(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("task_id").agg(
        F.max("attempt_number").alias("attempt_number"),
        F.max("fencing_token").alias("fencing_token"),
    )


def latest_attempt(attempts: DataFrame) -> DataFrame:
    return first_per_key(attempts, ["task_id"], [F.desc("attempt_number"), F.desc("id")])


def file_type_summary(nodes: DataFrame) -> DataFrame:
    """Files and bytes per format, most frequent first."""
    return (
        nodes.filter(F.col("node_type") == "file")
        .groupBy(
            F.coalesce(F.nullif("format", F.lit("")), F.lit("unknown")).alias("format"), "task_id"
        )
        .agg(
            F.count("*").alias("file_count"),
            F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        )
    )


def top_formats(nodes: DataFrame, limit: int) -> DataFrame:
    return (
        file_type_summary(nodes)
        .groupBy("format")
        .agg(F.sum("file_count").alias("file_count"), F.sum("total_bytes").alias("total_bytes"))
        .orderBy(F.desc("file_count"), "format")
        .limit(limit)
    )
