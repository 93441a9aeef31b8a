"""Report sections over all tasks: diagnostics and issue classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions.predicates import blank_to
from cairnlens.operators.findings import truncate_per_task


def _items(
    df: DataFrame, source: str, state: str, code: str | None, message: str | None,
    path: str | None = None, task: str = "task_id", stable: str = "id",
) -> DataFrame:
    own = lambda name: F.col(name) if name else F.lit(None).cast("string")
    return df.select(
        F.col(task).alias("task_id"), F.lit(source).alias("source"), F.col(state).alias("state"),
        own(path).alias("logical_path"), own(code).alias("own_code"), own(message).alias("own_text"),
        "created_at", F.col(stable).cast("string").alias("stable_id"),
    )


def diagnostics_union(
    events: DataFrame, nodes: DataFrame, results: DataFrame, runs: DataFrame, tasks: DataFrame
) -> DataFrame:
    """Warnings, unsupported items and failures of every task, with default texts.

    Which state of which source is reported, and its default code and text, stands in
    ``vocab.DIAGNOSTIC_KINDS``.
    """
    items = [
        _items(tasks, "task", "status", "error_code", "error_message", task="id"),
        _items(runs, "analyzer_run", "status", "error_code", "error_message"),
        _items(nodes, "file_node", "extraction_status", "error_code", "error_message", "logical_path"),
        _items(results.filter(F.col("deleted_at").isNull()), "decompile_result", "status", None, None),
        _items(events, "task_event", "severity", None, "message", stable="event_sequence"),
    ]
    parts = []
    for rows, source in zip(items, ("task", "analyzer_run", "file_node", "decompile_result", "task_event")):
        kinds = {k[1]: k for k in vocab.DIAGNOSTIC_KINDS if k[0] == source}
        named = lambda at: vocab.mapping_column(F.col("state"), [(s, k[at]) for s, k in kinds.items()])  # noqa: E731, B023
        parts.append(rows.filter(F.col("state").isin(list(kinds))).select(
            "task_id", named(2).alias("category"), "source", "logical_path",
            blank_to("own_code", named(3)).alias("code"), blank_to("own_text", named(4)).alias("message"),
            "created_at", "stable_id",
        ))
    return reduce(DataFrame.unionByName, parts)


def diagnostics_page(diagnostics: DataFrame, limit: int = vocab.DIAGNOSTIC_LIMIT) -> DataFrame:
    """First diagnostics of each task by time, with the truncation flag."""
    return truncate_per_task(diagnostics, [F.col("created_at"), F.col("stable_id")], limit)


def issue_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("task_id", "category", "source").agg(
        F.count("*").alias("issue_count")
    )
