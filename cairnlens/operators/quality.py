"""Data-quality queries: constraints, manifests, completeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions import text
from cairnlens.functions.keyed import duplicate_keys
from cairnlens.operators.runs import finding_rule_cwe


def enum_violations(df: DataFrame, table: str, column: str) -> DataFrame:
    """Values outside the allowed list, with their frequency."""
    allowed = vocab.ALLOWED_VALUES[(table, column)]
    return (
        df.filter(~F.col(column).isin(allowed))
        .groupBy(F.col(column).alias("bad_value"))
        .agg(F.count("*").alias("row_count"))
        .select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "bad_value",
            "row_count",
        )
    )


def all_enum_violations(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        enum_violations(tables[table], table, column)
        for table, column in vocab.ALLOWED_VALUES
        if table in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def foreign_key_violations(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str = "id"
) -> DataFrame:
    """Child rows that name a missing parent."""
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return duplicate_keys(df, keys)


def source_range_violations(results: DataFrame) -> DataFrame:
    """Ranges must be absent or complete, non-empty and in order."""
    names = ["source_offset_bytes", "source_length_bytes", "source_start_line", "source_end_line"]
    absent = reduce(lambda a, b: a & b, [F.col(name).isNull() for name in names])
    good = (
        F.col("source_offset_bytes").isNotNull()
        & (F.col("source_length_bytes") > 0)
        & (F.col("source_start_line") > 0)
        & (F.col("source_end_line") >= F.col("source_start_line"))
    )
    return results.filter(~(absent | F.coalesce(good, F.lit(False))))


def part_completeness(uploads: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts contiguous from 1, of the declared total size, each with its digest."""
    seen = parts.groupBy(F.col("upload_id").alias("id")).agg(
        F.count("*").alias("part_count"),
        F.count_distinct("part_number").alias("_numbers"),
        F.min("part_number").alias("_first"),
        F.max("part_number").alias("_last"),
        F.sum("size_bytes").alias("part_bytes"),
        F.bool_and(F.col("sha256") == F.col("actual_sha256")).alias("digests_match"),
    )
    return uploads.join(seen, "id", "left").select(
        "id",
        F.coalesce("part_count", F.lit(0)).alias("part_count"),
        F.coalesce(
            (F.col("_first") == 1)
            & (F.col("_last") == F.col("part_count"))
            & (F.col("_numbers") == F.col("part_count")),
            F.lit(False),
        ).alias("contiguous"),
        F.coalesce(F.col("part_bytes") == F.col("declared_size_bytes"), F.lit(False)).alias(
            "size_matches"
        ),
        F.coalesce("digests_match", F.lit(False)).alias("digests_match"),
    )


def manifest_compare(declared: DataFrame, actual: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Differences between declared and present files."""
    left = declared.select(
        key, "path", F.col("size_bytes").alias("declared_size"),
        F.col("sha256").alias("declared_sha256"),
    )
    right = actual.select(
        key, "path", F.col("size_bytes").alias("actual_size"),
        F.col("sha256").alias("actual_sha256"),
    )
    problem = (
        F.when(F.col("actual_sha256").isNull(), "missing")
        .when(F.col("declared_sha256").isNull(), "unexpected")
        .when(F.col("declared_size") != F.col("actual_size"), "size_mismatch")
        .when(F.col("declared_sha256") != F.col("actual_sha256"), "digest_mismatch")
    )
    return (
        left.join(right, [key, "path"], "full_outer")
        .withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
    )


def _violations(df: DataFrame, id_column: str, checks: dict[str, Column]) -> DataFrame:
    """One row per failed check."""
    names = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    )
    return df.select(F.col(id_column).alias("row_id"), F.explode(names).alias("violation"))


def finding_violations(findings: DataFrame) -> DataFrame:
    """Findings with an unknown rule, severity, bad position or oversized text."""
    same_line = F.col("end_line") == F.col("start_line")
    checks = {
        "severity": F.col("severity").isin("LOW", "MEDIUM", "HIGH", "CRITICAL"),
        "message": text.valid_text("message", 2048),
        "snippet": F.octet_length("snippet") <= vocab.SNIPPET_BYTES,
        "line_order": F.col("end_line") >= F.col("start_line"),
        "column_order": ~same_line | (F.col("end_column") >= F.col("start_column")),
        "column": (F.col("start_column") > 0) & (F.col("end_column") > 0),
    }
    bad_rule = finding_rule_cwe(findings).select(
        F.col("id").alias("row_id"), F.lit("rule").alias("violation")
    )
    return _violations(findings, "id", checks).unionByName(bad_rule)


def _digest_groups(prefix: str):
    """(key, line, repeated) rows ordered by key and path -> one digest per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, broken, done = None, None, False, []

        def close():
            if digest is not None:
                done.append((current, None if broken else digest.hexdigest()))

        def rows():
            out = pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())],
                ["key", "input_sha256"],
            )
            done.clear()
            return out

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("key").type
            for key, line, repeated in zip(*(batch.column(n).to_pylist() for n in ("key", "line", "repeated"))):
                if digest is None or key != current:
                    close()
                    current, digest, broken = key, hashlib.sha256(prefix.encode()), False
                digest.update(line.encode())
                broken = broken or repeated
            if done:
                yield rows()
        close()
        if done:
            yield rows()

    return run


def input_digest(
    files: DataFrame, schema_version: str, fields: list[str], key: str = "project_id"
) -> DataFrame:
    """Order-stable digest of each project's files; none if a path is listed twice.

    A project's lines are sorted within one partition and hashed as a stream, so a
    project of any size needs no more memory than a batch.
    """
    line = F.concat(F.concat_ws("\x00", *[F.col(name).cast("string") for name in fields]), F.lit("\n"))
    rows = files.select(F.col(key).alias("key"), "logical_path", line.alias("line"))
    before = F.lag("logical_path").over(Window.partitionBy("key").orderBy("logical_path"))
    ordered = rows.withColumn("repeated", F.coalesce(before == F.col("logical_path"), F.lit(False)))
    kind = dict(rows.dtypes)["key"]
    digests = (
        ordered.select("key", "logical_path", "line", "repeated")
        .sortWithinPartitions("key", "logical_path").select("key", "line", "repeated")
        .mapInArrow(_digest_groups(schema_version + "\n"), f"key {kind}, input_sha256 string")
    )
    counts = rows.groupBy("key").agg(F.count("*").alias("file_count"))
    return counts.join(digests, counts["key"].eqNullSafe(digests["key"])).select(
        counts["key"].alias(key), "file_count", "input_sha256"
    )
