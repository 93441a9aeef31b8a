"""Exact top-k inner-product search by distributed histogram selection.

Scores are integers, so the k-th best score of a query is found by narrowing a
range: every pass scores all candidates again (a matrix product per batch is
cheaper than keeping all scores), counts them in equal bins of each query's current
range, adds the counts up over the cluster and keeps the bin that holds the k-th
value. When each range is one value wide, a last pass keeps what lies at or above
it. Ties at the k-th value are cut per batch to the smallest ids before they are
shuffled, then once more per query.

Queries go in blocks of bounded size; only a block and its ranges travel to the
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlens.llm.common import written

SCALE = 1024
BINS = 512
# Bounds of a block: its matrix has at most this many components (32 MB as 8-byte
# numbers) and rows, however many queries there are.
BLOCK_COMPONENTS = 1 << 22
BLOCK_QUERIES = 4096
SCORES_AT_ONCE = 1 << 22  # of a task; larger batches are taken in parts
EXACT = float(1 << 53)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v: rows whose vector is there and has finite components only.

    Components become floor(1024 * x). A null id takes no part. Repeated ids are
    kept as rows of their own. Vectors of unlike length meet as if the shorter one
    ended in zeros.
    """
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & ~bad).select(
        F.col(id_column).cast("bigint").alias("id"), scaled.alias("v")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, padded or cut to ``width`` components."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    at = 0
    for i, n in enumerate(lengths):
        out[i, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; float arithmetic where it is exact."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(rows)), np.int64)
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < EXACT:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _batches(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray):
    step = max(1, SCORES_AT_ONCE // max(1, len(ids)))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            row_ids = batch.column("id").to_numpy()
            rows = _matrix(batch.column("v"), matrix.shape[1])
            other = ids[:, None] != row_ids[None, :]
            for i, j in zip(*np.nonzero(~other)):  # of rows with the id, the query's own has its vector
                other[i, j] = (matrix[i] != rows[j]).any()
            yield row_ids, _scores(matrix, rows), other


def _extremes(ids, matrix):
    """Per task: smallest and largest score and the number of candidates of each query."""

    def run(batches):
        low = np.full(len(ids), np.iinfo(np.int64).max)
        high = np.full(len(ids), np.iinfo(np.int64).min)
        count = np.zeros(len(ids), np.int64)
        for _, s, other in _batches(batches, ids, matrix):
            low = np.minimum(low, np.where(other, s, np.iinfo(np.int64).max).min(1))
            high = np.maximum(high, np.where(other, s, np.iinfo(np.int64).min).max(1))
            count += other.sum(1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(ids), dtype=np.int64)), pa.array(low), pa.array(high), pa.array(count)],
            ["q", "low", "high", "n"],
        )

    return run


def _histogram(ids, matrix, low, high, step, open_queries):
    """Per task: how many scores of each open query fall into each of its bins."""

    def run(batches):
        counts = np.zeros((len(open_queries), BINS), np.int64)
        lows, highs, steps = low[open_queries], high[open_queries], step[open_queries]
        for _, s, other in _batches(batches, ids[open_queries], matrix[open_queries]):
            for i in range(len(open_queries)):
                inside = s[i][other[i] & (s[i] >= lows[i]) & (s[i] <= highs[i])]
                counts[i] += np.bincount((inside - lows[i]) // steps[i], minlength=BINS)
        q, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(open_queries[q].astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(counts[q, b])],
            ["q", "bin", "n"],
        )

    return run


def _at_least(ids, matrix, floor_, k):
    """Rows at or above each query's k-th score, at most the k best of a batch."""

    def run(batches):
        for row_ids, s, other in _batches(batches, ids, matrix):
            found = []
            for i in range(len(ids)):
                at = np.flatnonzero(other[i] & (s[i] >= floor_[i]))
                if len(at) > k:
                    at = at[np.lexsort((row_ids[at], -s[i][at]))[:k]]
                found.append((np.full(len(at), i), np.full(len(at), ids[i]), row_ids[at], s[i][at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f[j] for f in found]).astype(np.int64)) for j in range(4)],
                ["q", "query_id", "vec_id", "score"],
            )

    return run


def _block(rows: DataFrame, queries: list, k: int) -> DataFrame:
    width = max(len(v) for _, v in queries)
    ids = np.array([i for i, _ in queries], np.int64)
    matrix = np.zeros((len(queries), width))
    for i, (_, v) in enumerate(queries):
        matrix[i, : len(v)] = v
    ends = rows.mapInArrow(_extremes(ids, matrix), "q long, low long, high long, n long").groupBy("q").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
    ).collect()
    low, high, want = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for r in ends:
        if r["n"]:
            low[r["q"]], high[r["q"]], want[r["q"]] = r["low"], r["high"], min(k, r["n"])
    # All of a query's scores that count lie in [low, high]; the want-th best is sought.
    while True:
        open_queries = np.flatnonzero((high > low) & (want > 0))
        if not len(open_queries):
            break
        step = (high - low) // BINS + 1
        counted = rows.mapInArrow(
            _histogram(ids, matrix, low, high, step, open_queries), "q long, bin long, n long"
        ).groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # The bin of the want-th value: one row per query comes back.
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        goal = F.element_at(F.array(*[F.lit(int(w)) for w in want]), F.col("q").cast("int") + 1)
        places = (
            counted.withColumn("upto", F.sum("n").over(down))
            .where((F.col("upto") >= goal) & (F.col("upto") - F.col("n") < goal))
            .select("q", "bin", (F.col("upto") - F.col("n")).alias("above"))
            .collect()
        )
        for r in places:
            q = r["q"]
            low[q] += r["bin"] * step[q]
            high[q] = min(high[q], low[q] + step[q] - 1)
            want[q] -= r["above"]
    near = rows.mapInArrow(_at_least(ids, matrix, low, k), "q long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("q")


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` per query.

    A row with the query's own id and vector is no candidate. Queries of one id with
    unlike vectors have a ranking each. Fewer candidates than k: all of them. Equal scores: the smaller id first. Unusable rows:
    see ``usable``; an empty table gives no rows; only the two named columns are read,
    whatever further ones are called. Scores beyond 64 bits are not told apart. Queries with the
    same id and vector count once.
    """
    rows = usable(vectors, id_column, vector_column)
    asked = usable(queries, id_column, vector_column).distinct()
    spark = vectors.sparkSession
    result, block, size = None, [], 0

    def add(result, block):
        part = written(_block(rows, block, k), "topk")
        return part if result is None else result.unionByName(part)

    for row in asked.orderBy("id").toLocalIterator():  # one block at a time is held
        block.append((row["id"], row["v"]))
        size += max(1, len(row["v"]))
        if size >= BLOCK_COMPONENTS or len(block) == BLOCK_QUERIES:
            result, block, size = add(result, block), [], 0
    if block:
        result = add(result, block)
    if result is None:
        result = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
