"""Ordered computations within a project or task: offsets, overlaps, budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions import chunks, text


def canonical_offsets(
    fragments: DataFrame,
    header: str = "/* Pseudo-C project %s. Not original buildable C source. */\n\n",
    banner: str = "/* function %06d | address %s | name %s */\n",
    span: int = chunks.DEFAULT_SPAN,
) -> DataFrame:
    """Place of every fragment when a project is written as one source file.

    A project is its header, then per fragment a one-line banner, the body and a
    separator: one newline after a body that ends with one, else two.
    """
    key = ["project_id"]
    numbered = chunks.prefix_totals(
        fragments, key, "ordinal", {"_before": F.lit(1)}, span=span
    )
    body = F.col("body")
    separator = F.when(F.endswith(body, F.lit("\n")), 1).otherwise(2)
    banner_text = F.format_string(
        banner, (F.col("_before") + 1).cast("int"), F.col("address"), F.col("name")
    )
    sized = (
        numbered.withColumn("_banner", F.octet_length(banner_text))
        .withColumn("length_bytes", F.octet_length(body))
        .withColumn("_lines", text.newline_count(body))
        .withColumn("_separator", separator)
    )
    placed = chunks.prefix_totals(
        sized,
        key,
        "ordinal",
        {
            "_bytes_before": F.col("_banner") + F.col("length_bytes") + F.col("_separator"),
            "_lines_before": F.col("_lines") + 1 + F.col("_separator"),
        },
        span=span,
    )
    head_text = F.format_string(header, F.col("project_id").cast("string"))
    offset = F.octet_length(head_text) + F.col("_bytes_before") + F.col("_banner")
    start = F.lit(1 + header.count("\n")) + F.col("_lines_before") + 1
    return placed.select(
        "project_id",
        "ordinal",
        offset.alias("offset_bytes"),
        "length_bytes",
        start.alias("start_line"),
        (start + text.line_span(body) - 1).alias("end_line"),
    )


def range_overlaps(functions: DataFrame, span: int = chunks.DEFAULT_SPAN) -> DataFrame:
    """Functions that start before an earlier one of their project has ended."""
    seen = chunks.prefix_maxima(
        functions,
        ["project_id"],
        "offset_bytes",
        {
            "_end": F.col("offset_bytes") + F.col("length_bytes"),
            "_line": F.col("end_line"),
        },
        ties=["result_id"],
        span=span,
    )
    bytes_overlap = F.coalesce(F.col("_end") > F.col("offset_bytes"), F.lit(False))
    lines_overlap = F.coalesce(F.col("_line") >= F.col("start_line"), F.lit(False))
    return (
        seen.withColumn("bytes_overlap", bytes_overlap)
        .withColumn("lines_overlap", lines_overlap)
        .filter("bytes_overlap OR lines_overlap")
        .drop("_end", "_line")
    )


def extraction_budget(
    entries: DataFrame,
    max_expanded: int = vocab.MAX_EXPANDED_BYTES,
    max_ratio: int = vocab.MAX_ARCHIVE_RATIO,
    max_nodes: int = vocab.MAX_FILE_NODES,
    max_depth: int = vocab.MAX_DEPTH,
    span: int = chunks.DEFAULT_SPAN,
) -> DataFrame:
    """Bytes each entry may still expand to, and the limit that cut it.

    Limits on the whole task (bytes, ratio to the root, nodes) stop all later
    entries; the ratio of one container only cuts entries of that container. Tasks of
    at most ``span`` entries are dealt out once, whole; only larger ones are cut.
    """
    limits = (max_expanded, max_ratio, max_nodes, max_depth)
    small, large = chunks.parted(entries, "task_id", span)

    def whole(rows, keys, order, totals, ties):
        return chunks.key_totals(rows, keys, order, totals, ties)

    def cut(rows, keys, order, totals, ties):
        return chunks.prefix_totals(rows, keys, order, totals, ties, span)

    return _budget(small.repartition("task_id"), whole, *limits).unionByName(_budget(large, cut, *limits))


def _budget(
    entries: DataFrame, prefix: Callable[..., DataFrame], max_expanded: int, max_ratio: int, max_nodes: int, max_depth: int
) -> DataFrame:
    ties = ["entry_key"]
    size = F.col("expanded_bytes")
    local = prefix(entries, ["task_id", "container_id"], "ordinal", {"_container_before": size}, ties)
    container_left = F.greatest(
        F.col("container_size_bytes") * max_ratio - F.col("_container_before"), F.lit(0)
    )
    cut = local.withColumn("_container_left", container_left).withColumn(
        "_granted", F.least(size, F.col("_container_left"))
    )
    whole = prefix(
        cut, ["task_id"], "ordinal", {"_total_before": F.col("_granted"), "_nodes_before": F.lit(1)}, ties
    )
    total_left = F.greatest(F.lit(max_expanded) - F.col("_total_before"), F.lit(0))
    ratio_left = F.greatest(
        F.col("root_size_bytes") * max_ratio - F.col("_total_before"), F.lit(0)
    )
    whole = whole.withColumn("_total_left", total_left).withColumn("_ratio_left", ratio_left)
    allowed = F.least(size, F.col("_total_left"), F.col("_ratio_left"), F.col("_container_left"))
    code: Column = (
        F.when(F.col("depth") > max_depth, "max_depth")
        .when(F.col("_nodes_before") >= max_nodes, "max_nodes")
        .when(size <= allowed, F.lit(None).cast("string"))
        .when(F.col("_total_left") <= allowed, "max_expanded_bytes")
        .otherwise("max_ratio")
    )
    global_cap = F.least(F.lit(max_expanded), F.col("root_size_bytes") * max_ratio)
    stopped = (F.col("_total_before") > global_cap) | (F.col("_nodes_before") > max_nodes)
    return whole.select(
        "task_id",
        "container_id",
        "ordinal",
        "entry_key",
        allowed.alias("allowed_bytes"),
        code.alias("limit_code"),
        stopped.alias("after_stop"),
    )
