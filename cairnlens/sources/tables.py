"""Fixed-schema table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlens import schemas


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table with its declared schema, so no file is opened to infer it."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    return spark.read.schema(schemas.TABLE_SCHEMAS[name]).parquet(path)
