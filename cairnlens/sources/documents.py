"""Document and file sources: reports, program and class indexes, stored blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlens import schemas
from cairnlens.functions.text import storage_key
from cairnlens.sources.blobs import BlobInventory

CORRUPT = "_corrupt"


def _documents(spark: SparkSession, path: str, schema: str, one_per_file: bool) -> DataFrame:
    return (
        spark.read.schema(f"{schema}, {CORRUPT} STRING")
        .option("multiLine", one_per_file)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def scan_reports(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Nested vulnerability reports; a broken document keeps its text in ``_corrupt``."""
    return _documents(spark, path, schemas.REPORT, one_per_file)


def scan_program_index(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    return _documents(spark, path, schemas.PROGRAM_INDEX, one_per_file)


def scan_class_index(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    return _documents(spark, path, schemas.CLASS_INDEX, one_per_file)


def scan_blobs(spark: SparkSession, path: str, name_filter: str = "*") -> DataFrame:
    """Content-addressed inventory of stored files of any size.

    Tasks read files in blocks and keep nothing but the digest.
    """
    spark.dataSource.register(BlobInventory)
    files = spark.read.format(BlobInventory.name()).option("pattern", name_filter).load(path)
    return files.withColumn("storage_key", storage_key("sha256"))
