"""Vulnerability findings: summaries, risk and report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions.keyed import ranked_per_key
from cairnlens.functions.predicates import (
    fixable, risk_of_rank, severity_position, severity_rank,
)


def severity_summary(findings: DataFrame) -> DataFrame:
    """Total, fixable and one count per severity for each task."""
    return findings.groupBy("task_id").agg(
        F.count("*").alias("total"),
        F.count_if(fixable()).alias("fixable"),
        *[
            F.count_if(F.col("severity") == name).alias(name.lower())
            for name in vocab.SEVERITIES
        ],
    )


def severity_breakdown(findings: DataFrame) -> DataFrame:
    """Count and fixable count per task and severity, with the display position."""
    return (
        findings.groupBy("task_id", "severity")
        .agg(F.count("*").alias("finding_count"), F.count_if(fixable()).alias("fixable"))
        .withColumn("position", severity_position())
    )


def task_risk(tasks: DataFrame, findings: DataFrame) -> DataFrame:
    """Highest severity of each task; a task without findings has risk NONE."""
    worst = findings.groupBy("task_id").agg(F.max(severity_rank()).alias("rank"))
    return tasks.join(worst, tasks["id"] == worst["task_id"], "left").select(
        F.col("id").alias("task_id"),
        F.coalesce("rank", F.lit(0)).alias("risk_rank"),
        risk_of_rank(F.coalesce("rank", F.lit(0))).alias("risk_level"),
    )


def findings_with_database(findings: DataFrame, bundles: DataFrame) -> DataFrame:
    named = bundles.select(
        F.col("id").alias("bundle_id"),
        F.col("version").alias("bundle_version"),
        F.col("generated_at").alias("bundle_generated_at"),
    )
    return findings.join(
        named, findings["database_bundle_id"] == named["bundle_id"], "left"
    )


def databases_used(bundles: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Bundles named by a finding or by a run's recorded parameters."""
    from_findings = findings.select(F.col("database_bundle_id").alias("id"))
    from_runs = runs.select(
        F.try_to_number(
            F.get_json_object("parameters_json", "$.database_bundle.id"), F.lit("999999999999999999")
        ).cast("bigint").alias("id")
    )
    # distinct within each side first: each is reduced to a handful of keys map-side
    used = from_findings.distinct().unionByName(from_runs.distinct()).distinct()
    return bundles.join(used, "id", "left_semi")


def run_publication_check(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Stored findings of a run against its declared count and database."""
    declared = runs.select(
        F.col("id").alias("run_id"), "declared_finding_count", "declared_bundle_id"
    )
    stored = findings.groupBy(F.col("analyzer_run_id").alias("run_id"), "database_bundle_id").agg(
        F.count("*").alias("n")
    )
    return (
        declared.join(stored, "run_id", "left")
        .groupBy("run_id", "declared_finding_count", "declared_bundle_id")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("stored_count"),
            F.coalesce(
                F.sum(F.when(F.col("database_bundle_id") == F.col("declared_bundle_id"), F.col("n"))),
                F.lit(0),
            ).alias("matching_count"),
        )
        .withColumn(
            "complete",
            (F.col("stored_count") == F.col("declared_finding_count"))
            & (F.col("matching_count") == F.col("stored_count")),
        )
    )


def truncate_per_task(df: DataFrame, order: list, limit: int, key: str = "task_id") -> DataFrame:
    """First ``limit`` rows of each task; ``truncated`` says whether more existed."""
    kept = ranked_per_key(df, [key], order, limit + 1, "position")
    # at most limit + 1 rows per task are left, already gathered by task
    last = F.max("position").over(Window.partitionBy(key))
    return kept.withColumn("truncated", last > limit).filter(F.col("position") <= limit)


def ordered_by_severity(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.orderBy(severity_position(), *keys)
