"""Analysis runs, source projects, cached results and report dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions.keyed import drop_matching, first_per_key


def project_runs(runs: DataFrame, projects: DataFrame, analyzers: DataFrame) -> DataFrame:
    """Published runs of live projects with their analyzer."""
    live = projects.filter(
        F.col("deleted_at").isNull() & F.col("storage_deleted_at").isNull()
    ).select("task_id", F.col("id").alias("source_project_id"))
    named = analyzers.select("task_id", "id", "analyzer_name", "analyzer_version")
    published = runs.filter(
        F.col("status").isin("succeeded", "partial")
        & F.col("completed_at").isNotNull()
        & F.col("deletion_started_at").isNull()
    )
    return published.join(live, ["task_id", "source_project_id"]).join(named, ["task_id", "id"])


def latest_run_per_project(published: DataFrame) -> DataFrame:
    """Newest completed run of each project and language."""
    return first_per_key(
        published,
        ["task_id", "source_project_id", "language"],
        [F.desc("completed_at"), F.desc("id")],
    )


def findings_latest_run(findings: DataFrame, latest: DataFrame) -> DataFrame:
    current = latest.select(
        F.col("id").alias("run_id"), "task_id", "source_project_id", "language"
    )
    return findings.join(current, "run_id")


def report_dependencies(report_runs: DataFrame, published: DataFrame) -> DataFrame:
    """Which run references of a report still hold: same completion and same source."""
    now = published.select(
        F.col("id").alias("run_id"),
        "source_project_id",
        F.col("completed_at").alias("_completed_at"),
        F.col("source_sha256").alias("_source_sha256"),
    )
    return report_runs.join(now, ["run_id", "source_project_id"], "left").select(
        "report_id",
        "run_id",
        F.coalesce(
            (F.col("_completed_at") == F.col("completed_at"))
            & (F.col("_source_sha256") == F.col("source_sha256")),
            F.lit(False),
        ).alias("holds"),
    )


def active_project_analysis(runs: list[DataFrame], jobs: DataFrame) -> DataFrame:
    """Projects with an unfinished run or job, over the union of the given run tables."""
    job = jobs.select("task_id", F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    every = reduce(
        DataFrame.unionByName,
        [df.select("task_id", "source_project_id", "job_id", "status") for df in runs],
    )
    busy = F.col("job_status").isin(vocab.ACTIVE_JOB_STATUSES) | F.col("status").isin(
        "queued", "running", "cancel_requested"
    )
    return (
        every.join(job, ["task_id", "job_id"])
        .filter(busy)
        .select("task_id", F.col("source_project_id").alias("id"))
        .distinct()
    )


def rule_severity_rollup(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id").agg(
        F.count("*").alias("finding_count"),
        *[
            F.count_if(F.col("severity") == name).alias(f"{name.lower()}_count")
            for name in ("LOW", "MEDIUM", "HIGH", "CRITICAL")
        ],
    )


def distinct_findings(findings: DataFrame, source: str) -> DataFrame:
    """One finding per rule and start position within a source file."""
    return first_per_key(
        findings, [source, "rule_id", "start_line", "start_column"], [F.col("id")]
    )


def analysis_status(coverage: DataFrame, language: str) -> DataFrame:
    """Outcome of a run from its coverage counts."""
    truncated = F.col("findings_truncated") | F.col("diagnostics_truncated")
    if language == "c":
        failed = (F.col("parsed") == 0) & (F.col("failed") > 0)
        partial = (F.col("failed") > 0) | truncated | (F.col("project_status") == "partial")
        done = "succeeded"
    else:
        failed = F.col("analyzed") == 0
        partial = (
            (F.col("project_status") == "partial")
            | (F.col("recovered") > 0)
            | (F.col("failed") > 0)
            | (F.col("analyzed") < F.col("parsed"))
            | truncated
        )
        done = "complete"
    return coverage.withColumn(
        "analysis_status", F.when(failed, "failed").when(partial, "partial").otherwise(done)
    )


def finding_rule_cwe(findings: DataFrame) -> DataFrame:
    """Findings whose rule is unknown or does not belong to their weakness class."""
    rules = vocab.frame(findings.sparkSession, vocab.C_RULE_CWES, "rule_id, cwe")
    return findings.join(rules, ["rule_id", "cwe"], "left_anti")


LISTED_PROJECTS = 10_000


def finding_in_function(
    hits: DataFrame, functions: DataFrame, lines_per_bin: int = 256
) -> DataFrame:
    """Hits with the functions of their project that enclose their lines.

    Functions are listed in line bins whose size grows fourfold per level, each at the
    level where it touches two bins at most; a hit looks into its bin of every level
    that its project's functions stand on, mostly one. So hits meet only functions near
    them, and a range with a broken end costs two rows. Ranges that end before they
    start enclose nothing. Hits are dealt out once: the projects of a level are sent to
    all tasks, and a level of more than ``LISTED_PROJECTS`` is looked into by every hit.
    """
    levels = 16  # the widest bins hold more lines than an integer counts

    def bin_of(column: str, level: Column) -> Column:
        return F.floor(F.col(column) / (F.lit(lines_per_bin) * F.pow(F.lit(4), level))).cast("bigint")

    length = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log(length / lines_per_bin) / F.log(F.lit(4.0)))).cast("int")
    spread = (
        functions.filter(F.col("end_line") >= F.col("start_line"))
        .select("project_id", "result_id", "start_line", "end_line", F.least(level, F.lit(levels)).alias("level"))
        .select(
            "project_id", "result_id", F.col("start_line").alias("function_start"),
            F.col("end_line").alias("function_end"), "level",
            F.explode(F.array_distinct(F.array(
                bin_of("start_line", F.col("level")), bin_of("end_line", F.col("level"))
            ))).alias("line_bin"),
        )
    )
    used = spread.select("project_id", "level").distinct()
    found = {r["level"]: r["n"] for r in used.groupBy("level").agg(F.count("*").alias("n")).collect()}
    common = sorted(level for level, n in found.items() if n > LISTED_PROJECTS)
    listed = F.broadcast(
        used.where(~F.col("level").isin(common)).groupBy("project_id").agg(F.collect_set("level").alias("levels"))
    )
    looking = hits.join(listed, "project_id").withColumn("level", F.explode("levels")).drop("levels")
    if common:
        every = hits.withColumn("level", F.explode(F.array(*map(F.lit, common))))
        looking = every.unionByName(looking)
    looking = looking.withColumn("line_bin", bin_of("start_line", F.col("level")))
    return (
        looking.join(spread, ["project_id", "level", "line_bin"])
        .filter(
            (F.col("start_line") >= F.col("function_start"))
            & (F.col("end_line") <= F.col("function_end"))
        )
        .drop("level", "line_bin")
    )


CACHE_FIELDS = [
    "analyzer_parameters_sha256", "cache_parameters_sha256", "reuse_identity_sha256",
    "reuse_contract", "engine_target", "source_sha256", "source_size_bytes", "source_format",
    "source_architecture",
]


def run_completeness(runs: DataFrame, results: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Finished runs whose stored results agree with everything the run declares."""
    declared = runs.select(
        F.col("id").alias("analyzer_run_id"),
        "task_id",
        F.col("file_node_id").alias("_node"),
        F.col("analyzer_name").alias("_engine"),
        F.col("analyzer_version").alias("_version"),
        F.get_json_object("parameters_json", "$.result_status").alias("_status"),
        F.get_json_object("parameters_json", "$.result_count").cast("bigint").alias("_count"),
    )
    json_bytes = F.octet_length("diagnostics_json")
    fine = (
        F.col("deleted_at").isNull()
        & (F.col("file_node_id") == F.col("_node"))
        & (F.col("engine_name") == F.col("_engine"))
        & (F.col("engine_version") == F.col("_version"))
        & (F.col("status") == F.col("_status"))
        & F.col("completed_at").isNotNull()
        & F.col("storage_key").isNotNull()
        & F.col("content_sha256").isNotNull()
        & (F.col("size_bytes") > 0)
        & json_bytes.between(1, limits["json_bytes"])
    )
    live = F.col("deleted_at").isNull()
    return (
        declared.join(results, ["task_id", "analyzer_run_id"])
        .groupBy("task_id", "analyzer_run_id", "_count")
        .agg(
            F.count_if(live).alias("result_count"),
            F.coalesce(F.sum(F.when(live, F.col("size_bytes"))), F.lit(0)).alias("total_bytes"),
            F.coalesce(F.sum(F.when(live, json_bytes)), F.lit(0)).alias("total_json_bytes"),
            F.bool_and(F.coalesce(fine, F.lit(False))).alias("consistent"),
        )
        .withColumn(
            "complete",
            F.coalesce(
                F.col("consistent")
                & (F.col("result_count") == F.col("_count"))
                & F.col("_count").between(1, limits["results"])
                & F.col("total_bytes").between(1, limits["total_bytes"])
                & F.col("total_json_bytes").between(1, limits["total_json_bytes"]),
                F.lit(False),
            ),
        )
        .drop("_count")
    )


def cache_candidates(
    runs: DataFrame, tasks: DataFrame, results: DataFrame, as_of_column: Column,
    limits: dict[str, int],
) -> DataFrame:
    """Newest reusable finished run for every running run.

    Runs of one cache identity are never paired with each other: the best source per
    identity is chosen first, then looked up by the running runs.
    """
    usable = tasks.filter(
        F.col("status").isin(vocab.TERMINAL_TASK_STATUSES)
        & F.col("sample_deleted_at").isNull()
        & (F.col("sample_expires_at") > as_of_column)
        & F.col("deleted_at").isNull()
    ).select(F.col("id").alias("task_id"))
    runs = runs.join(usable, "task_id", "left_semi")
    # one parse of the parameters yields all identity fields
    parameters = F.from_json("parameters_json", ", ".join(f"{name} STRING" for name in CACHE_FIELDS))
    runs = runs.withColumn("_parameters", parameters).select(
        "*", *[F.col(f"_parameters.{name}").alias(name) for name in CACHE_FIELDS]
    ).drop("_parameters")
    keys = ["cache_identity", "analyzer_name", "analyzer_version", *CACHE_FIELDS]
    finished = runs.filter(
        (F.col("status") == "succeeded")
        & F.col("completed_at").isNotNull()
        & F.get_json_object("parameters_json", "$.result_status").isin("complete", "bytecode_only")
    )
    complete = (
        run_completeness(finished, results, limits)
        .filter("complete")
        .select("task_id", F.col("analyzer_run_id").alias("id"))
    )
    sources = finished.join(complete, ["task_id", "id"], "left_semi")
    best = first_per_key(sources, keys, [F.desc("completed_at"), F.desc("id")]).select(
        *keys, F.col("id").alias("source_run_id"), F.col("task_id").alias("source_task_id")
    )
    running = runs.filter(F.col("status") == "running")
    return running.join(best, keys).select("id", "source_run_id", "source_task_id")


def project_rollup(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Kind, language, status and totals of the project behind each run."""
    stored = (
        F.col("storage_key").isNotNull()
        & F.col("content_sha256").isNotNull()
        & F.col("size_bytes").isNotNull()
        & F.col("result_status").isin("complete", "partial", "bytecode_only")
    )
    run = runs.filter(F.col("file_node_id").isNotNull()).select(
        F.col("id").alias("analyzer_run_id"),
        "task_id",
        "analyzer_name",
        F.col("status").alias("run_status"),
        F.col("created_at").alias("run_created_at"),
        F.col("completed_at").alias("run_completed_at"),
    )
    live = results.filter(F.col("deleted_at").isNull()).select(
        "task_id", "analyzer_run_id", "storage_key", "content_sha256", "size_bytes", "language",
        F.col("status").alias("result_status"), "created_at", "completed_at",
    )
    language = F.when(stored, F.col("language"))
    # one pass over the results per run; the run's own columns are joined afterwards
    totals = live.groupBy("task_id", "analyzer_run_id").agg(
        F.count("*").alias("symbol_count"),
        F.count_if(F.col("result_status") == "complete").alias("_complete"),
        F.count_if(F.col("result_status") == "bytecode_only").alias("_bytecode"),
        *[
            F.count_if(stored & (F.col("language") == name)).alias(f"_{name}")
            for name in ("java", "kotlin", "python")
        ],
        # one language only: smallest and largest agree, no distinct count needed
        F.min(language).alias("_language"),
        F.max(language).alias("_last_language"),
        F.count_distinct(F.when(stored, F.col("storage_key"))).alias("source_file_count"),
        F.coalesce(F.sum(F.when(stored, F.col("size_bytes"))), F.lit(0)).alias("source_size_bytes"),
        F.min("created_at").alias("_first"),
        F.max("completed_at").alias("_last"),
    )
    native = F.col("analyzer_name") == "ghidra"
    kind = F.when(native, "ghidra-pseudoc")
    for name in ("java", "kotlin", "python"):
        kind = kind.when(F.col(f"_{name}") > 0, name)
    return (
        run.join(totals.filter("source_file_count > 0"), ["task_id", "analyzer_run_id"])
        .select(
            F.col("analyzer_run_id").alias("id"),
            kind.otherwise("bytecode").alias("source_kind"),
            F.when(native, "c").when(F.col("_language") == F.col("_last_language"), F.col("_language"))
            .otherwise("mixed").alias("language"),
            F.when(F.col("run_status") == "partial", "partial")
            .when(F.col("_complete") == F.col("symbol_count"), "complete")
            .when(F.col("_bytecode") == F.col("symbol_count"), "bytecode_only")
            .otherwise("partial").alias("status"),
            "source_file_count",
            "symbol_count",
            "source_size_bytes",
            F.least("run_created_at", "_first").alias("created_at"),
            F.coalesce("run_completed_at", "_last").alias("completed_at"),
        )
    )


def deletion_impact(
    projects: DataFrame, runs: DataFrame, findings: DataFrame, reports: DataFrame,
    results: DataFrame,
) -> DataFrame:
    """What deleting each project removes. Python runs are not counted."""
    counted = runs.filter(F.col("language").isin("c", "java"))
    keys = ["task_id", "source_project_id"]
    run_counts = counted.groupBy(*keys).agg(
        F.count_if(F.col("language") == "c").alias("c_runs"),
        F.count_if(F.col("language") == "java").alias("java_runs"),
    )
    per_run = findings.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n"))
    finding_counts = (
        counted.join(per_run, "id")
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("language") == "c", F.col("n"))).alias("c_findings"),
            F.sum(F.when(F.col("language") == "java", F.col("n"))).alias("java_findings"),
        )
    )
    report_counts = reports.groupBy("task_id").agg(
        F.count("*").alias("reports"),
        F.count("storage_key").alias("report_files"),
        F.count_distinct("artifact_id").alias("artifacts"),
    )
    result_counts = results.groupBy(
        "task_id", F.col("analyzer_run_id").alias("source_project_id")
    ).agg(F.count("*").alias("results"))
    base = projects.select("task_id", F.col("id").alias("source_project_id"))
    names = [
        "c_runs", "c_findings", "java_runs", "java_findings", "reports", "report_files",
        "artifacts", "results",
    ]
    return (
        base.join(run_counts, keys, "left")
        .join(finding_counts, keys, "left")
        .join(report_counts, "task_id", "left")
        .join(result_counts, keys, "left")
        .select(*keys, *[F.coalesce(name, F.lit(0)).alias(name) for name in names])
    )


def current_before_staged(reports: DataFrame) -> DataFrame:
    """Visible reports of a task, the current one before the staged ones."""
    visible = reports.filter(
        F.col("deleted_at").isNull()
        & (
            ((F.col("snapshot_state") == "current") & (F.col("status") == "complete"))
            | (
                (F.col("snapshot_state") == "staged")
                & F.col("status").isin("queued", "generating")
            )
        )
    )
    return visible.orderBy(
        "task_id", "format", F.col("snapshot_state") != "current", F.desc("generation"),
        F.desc("id"),
    )


def batch_complete(batches: DataFrame, items: DataFrame) -> DataFrame:
    """Open batches all of whose items are settled."""
    open_items = items.filter(F.col("outcome").isin("pending", "processing")).select(
        F.col("batch_id").alias("id")
    )
    return drop_matching(batches.filter(F.col("status") == "processing"), open_items, ["id"])


def import_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("archive_import_id").agg(
        F.count("*").alias("total"),
        *[
            F.count_if(F.col("status") == name).alias(name)
            for name in ("eligible", "skipped", "created", "failed")
        ],
    )


def import_skip_reasons(entries: DataFrame) -> DataFrame:
    return (
        entries.filter(F.col("status") == "skipped")
        .groupBy("archive_import_id", "skip_reason")
        .agg(F.count("*").alias("n"))
    )
