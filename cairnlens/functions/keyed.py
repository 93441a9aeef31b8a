"""Per-key steps that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
SPLIT_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer files than cores.

    For work that costs far more than moving a row: a table of a few row groups would
    be worked on by as many tasks. The number of parts grows with the size that is
    estimated for the rows, so one part does not. Inputs of many files stay where they
    are, and so do files that are read in a split of full size for each core at least.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if len(df.inputFiles()) >= cores or _stored_bytes(plan) >= cores * _split_bytes(df):
        return df
    size = int(str(plan.stats().sizeInBytes()))
    return df.repartition(max(cores, min(-(-size // SPLIT_BYTES), 100 * cores)), *df.columns)


def _stored_bytes(plan) -> int:
    """Size of the files that a plan reads."""
    leaves = plan.collectLeaves()
    files = [leaf for leaf in map(leaves.apply, range(leaves.size())) if leaf.nodeName() == "LogicalRelation"]
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in files)


def _split_bytes(df: DataFrame) -> int:
    return df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The ``= 1`` filter becomes a group limit before the shuffle, so each map task
    sends at most one row per key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def ranked_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each key with their rank, exactly.

    Rows are first cut to ``n`` per (key, input split group), then per key, so no
    task sees more than ``SALTS * n`` rows of one key in the last step. The salt
    only spreads work: any salting keeps the overall first ``n`` rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = (
        salted.withColumn("_rank", F.row_number().over(inner))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_salt")
    )
    outer = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= n)


def numbered(df: DataFrame, key: str, order: list[str], name: str, folder: str) -> DataFrame:
    """``df`` with each row's number, from 0, among the rows of its key in ``order``.

    Rows are dealt to tasks by ranges of (key, order), so a key with most of all rows is
    spread, and written to ``folder``, which fixes the dealing. Row marks of a part
    follow each other, so a row's number there is its mark's distance from the smallest
    one of its key; the rows of a key in earlier parts are added. Both come from a table
    of one row for each key and part.
    """
    spark, part = df.sparkSession, "_part"
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn(
        part, F.spark_partition_id()
    ).withColumn("_row", F.monotonically_increasing_id())
    dealt.write.option("compression", "zstd").parquet(folder)
    dealt = spark.read.schema(dealt.schema).parquet(folder)
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(key, part).agg(F.count("*").alias("_n"), F.min("_row").alias("_first")).select(
        F.col(key).alias("_key"), F.col(part).alias("_of"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    met = F.col(key).eqNullSafe(F.col("_key")) & (F.col(part) == F.col("_of"))
    own = dealt.join(offsets, met).withColumn(name, F.col("_row") + F.col("_shift"))
    return own.drop(part, "_row", "_key", "_of", "_shift")


def keep_matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Semi join on a key set made distinct before it is shuffled."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def drop_matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Anti join on a key set made distinct before it is shuffled."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")
