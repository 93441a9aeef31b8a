"""Ordered per-key computations cut into bounded chunks.

A window over a whole key puts all its rows into one task. These helpers window
over (key, chunk) instead, where a chunk is a fixed span of the numeric order
column, and carry the boundary value between chunks through a table with one row
per chunk. The order column is unique within a key (or nearly so), so a chunk
holds at most about ``span`` rows however many the key has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SPAN = 1 << 20
CHUNK = "_chunk"


def _meet(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their (key, chunk) entry; null keys meet too."""
    named = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(named, reduce(Column.__and__, same)).drop(*[f"_k_{k}" for k in keys])


def with_chunk(df: DataFrame, order: str, span: int = DEFAULT_SPAN) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(order) / F.lit(span)).cast("bigint"))


def parted(df: DataFrame, key: str, span: int = DEFAULT_SPAN) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys with at most ``span`` rows, and those of the others.

    There is one key of the second kind for each ``span`` rows at most, so their list is
    sent to all tasks.
    """
    many = df.groupBy(F.col(key).alias("_many")).agg(F.count("*").alias("_n")).where(F.col("_n") > span)
    listed = F.broadcast(many.select("_many"))
    same = F.col(key).eqNullSafe(F.col("_many"))
    return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")


def _neighbour(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    span: int,
    following: bool,
) -> DataFrame:
    chunked = with_chunk(df, order, span)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    if following:
        near, edge, carry = F.lead(value), F.min_by(value, order), F.lead("_edge")
    else:
        near, edge, carry = F.lag(value), F.max_by(value, order), F.lag("_edge")
    edges = (
        chunked.groupBy(*keys, CHUNK)
        .agg(edge.alias("_edge"))
        .select(*keys, CHUNK, carry.over(across).alias("_carried"))
    )
    return (
        _meet(chunked.withColumn("_near", near.over(inside)), edges, [*keys, CHUNK])
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_near", "_carried", CHUNK)
    )


def lag_value(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Previous value per key; ``value`` must not be null."""
    return _neighbour(df, keys, order, value, out, span, following=False)


def lead_value(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Next value per key; ``value`` must not be null."""
    return _neighbour(df, keys, order, value, out, span, following=True)


def key_totals(
    df: DataFrame, keys: list[str], order: str, totals: dict[str, Column], ties: list[str] | None = None
) -> DataFrame:
    """``prefix_totals`` for keys of few rows: one window over each whole key."""
    before = (
        Window.partitionBy(*keys)
        .orderBy(order, *(ties or []))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = [F.coalesce(F.sum(e.cast("bigint")).over(before), F.lit(0)).alias(name) for name, e in totals.items()]
    return df.select("*", *sums)


def prefix_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, Column],
    ties: list[str] | None = None,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Sum of all earlier rows of the key for each named expression."""
    chunked = with_chunk(df, order, span)
    for name, expression in totals.items():
        chunked = chunked.withColumn(f"_v_{name}", expression.cast("bigint"))
    before = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(order, *(ties or []))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = chunked.groupBy(*keys, CHUNK).agg(
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in totals]
    )
    offsets = sums.select(
        *keys,
        CHUNK,
        *[
            F.coalesce(F.sum(f"_s_{name}").over(across), F.lit(0)).alias(f"_o_{name}")
            for name in totals
        ],
    )
    inside = chunked.select(
        "*",
        *[
            F.coalesce(F.sum(f"_v_{name}").over(before), F.lit(0)).alias(f"_b_{name}")
            for name in totals
        ],
    )
    out = _meet(inside, offsets, [*keys, CHUNK])
    for name in totals:
        out = out.withColumn(name, F.col(f"_b_{name}") + F.col(f"_o_{name}"))
    return out.drop(CHUNK, *[f"_{part}_{name}" for name in totals for part in "vbo"])


def prefix_maxima(
    df: DataFrame,
    keys: list[str],
    order: str,
    maxima: dict[str, Column],
    ties: list[str] | None = None,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Largest value among all earlier rows of the key (null for the first)."""
    chunked = with_chunk(df, order, span)
    for name, expression in maxima.items():
        chunked = chunked.withColumn(f"_v_{name}", expression)
    before = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(order, *(ties or []))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    peaks = chunked.groupBy(*keys, CHUNK).agg(
        *[F.max(f"_v_{name}").alias(f"_s_{name}") for name in maxima]
    )
    offsets = peaks.select(
        *keys,
        CHUNK,
        *[F.max(f"_s_{name}").over(across).alias(f"_o_{name}") for name in maxima],
    )
    inside = chunked.select(
        "*",
        *[F.max(f"_v_{name}").over(before).alias(f"_b_{name}") for name in maxima],
    )
    out = _meet(inside, offsets, [*keys, CHUNK])
    for name in maxima:
        out = out.withColumn(name, F.greatest(f"_b_{name}", f"_o_{name}"))
    return out.drop(CHUNK, *[f"_{part}_{name}" for name in maxima for part in "vbo"])
