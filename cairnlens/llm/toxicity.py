"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one holds the common words
of ordinary text plus further ordinary words, the other the same common words plus
the words that mark toxic text. A window of a document that compresses clearly
shorter with the toxic dictionary speaks for toxicity. Both dictionaries share
their common part, so plain prose compresses alike and the difference is little
disturbed. A word counts once per context (its neighbours), which keeps copies of
one document from making its rare words look typical. Window differences become
a few figures per document; a logistic model, fitted on labelled documents that
the dictionaries have not seen, turns them into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlens.llm.common import fold, text_or_empty

WINDOW_BYTES = 64
FOLDS = 5
# Bound of the fitting sample: about this many labelled documents of each class for
# the dictionaries and, apart from them, as many for the calibration.
SAMPLE_PER_CLASS = 6000
COMMON_BYTES = 8192
TOXIC_BYTES = 8192
MIN_CONTEXTS = 5
MIN_EVIDENCE = 5.0
PUNCTUATION = b".,;:!?\"'()[]{}<>*#%&$|/\\-_=+"
FIGURES = 5


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # bias first


def windows(text: bytes, size: int = WINDOW_BYTES) -> list[bytes]:
    """Consecutive pieces of about ``size`` bytes, cut at spaces where there are any."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            space = text.rfind(b" ", at + size // 2, end)
            end = space if space > 0 else end
        out.append(text[at:end])
        at = end
    return out or [b""]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    content = content if len(content) >= 8 else content.ljust(8)
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(
            content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
        ),
        compression_params=zstandard.ZstdCompressionParameters.from_level(
            9, min_match=5, strategy=zstandard.STRATEGY_LAZY2, search_log=8,
            write_content_size=False, write_dict_id=False, write_checksum=False,
        ),
    )


def figures(text: str | None, ordinary, toxic) -> list[float]:
    """Largest saving, mean of the three largest, mean, two counts of large savings."""
    lowered = (text or "").lower().encode("utf-8", "surrogatepass")
    saved = np.array(
        [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(lowered)], float
    )
    top = np.sort(saved)[::-1][:3]
    return [
        float(top[0]), float(top.sum() / 3), float(saved.mean()),
        math.log1p(float((saved >= 3).sum())), math.log1p(float((saved >= 5).sum())),
    ]


def _figure_batches(model: ToxicityModel, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic = _compressor(model.ordinary), _compressor(model.toxic)
        for batch in batches:
            texts = batch.column("text")
            values = [figures(t.as_py(), ordinary, toxic) for t in texts]
            arrays = [batch.column(name) for name in keep]
            arrays.append(pa.array(values, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "figures"])

    return run


def with_figures(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    columns = keep if "text" in keep else [*keep, "text"]
    figures = T.StructField("figures", T.ArrayType(T.DoubleType()))
    schema = T.StructType([*(docs.schema[name] for name in keep), figures])
    return docs.select(*columns).mapInArrow(_figure_batches(model, keep), schema)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, word, context) with the context's hash, distinct within a batch."""
    import xxhash

    for batch in batches:
        found = set()
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            words = [w.strip(PUNCTUATION) for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]
            words = [w for w in words if w]
            for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
                found.add((toxic, word, xxhash.xxh3_64_intdigest(before + b" " + word + b" " + after) >> 1))
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            ["toxic", "word", "context"],
        )


def _taken(words: list[bytes], limit: int) -> list[bytes]:
    out, size = [], 0
    for word in words:
        if size + len(word) + 1 > limit:
            break
        out.append(word)
        size += len(word) + 1
    return out


def _joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(reversed(words)) + b" "


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method on scaled figures."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    ridge = np.diag([1e-6] + [0.3] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - ridge @ beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    slopes = beta[1:] / scale
    return np.r_[beta[0] - (slopes * mean).sum(), slopes]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Dictionaries and weights from labelled documents outside fold 0.

    Folds 1-3 make the dictionaries, fold 4 the calibration. Labels other than 0 and
    1 and null ids are left out; of several labels of one id the largest counts.
    The sampled label rows are bounded by ``per_class`` (in expectation), which is
    why they may be broadcast; word statistics come to the driver only for the at
    most ``TOXIC_BYTES`` and ``2 * COMMON_BYTES`` that fit the dictionaries.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("fold", fold("doc_id", FOLDS))
        .where("fold <> 0")
        .withColumn("calibrates", F.col("fold") == FOLDS - 1)
    )
    counts = {(r["toxic"], r["calibrates"]): r["count"] for r in marked.groupBy("toxic", "calibrates").count().collect()}
    rates = {key: min(1.0, per_class / n) for key, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20))
    limit = F.lit(0)
    for (toxic, calibrates), rate in sorted(rates.items()):
        limit = F.when(
            (F.col("toxic") == toxic) & (F.col("calibrates") == calibrates), int(rate * (1 << 20))
        ).otherwise(limit)
    sampled = marked.where(draw < limit).select("doc_id", "toxic", "calibrates")
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sampled), "doc_id")

    seen = (
        rows.where(~F.col("calibrates")).select("toxic", "text")
        .mapInArrow(_contexts, "toxic int, word binary, context bigint")
        .groupBy("toxic", "word").agg(F.count_distinct("context").alias("n"))
        .groupBy("word").agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"),
        )
    ).persist()
    total = seen.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    evidence = F.sqrt("a") * (
        F.log((F.col("a") + 0.5) / (total[0] + 1.0)) - F.log((F.col("b") + 2.0) / (total[1] + 4.0)) - 1.0
    )
    marks = [
        bytes(r["word"]) for r in seen.where((F.col("a") >= MIN_CONTEXTS) & (evidence >= MIN_EVIDENCE))
        .orderBy(evidence.desc(), "word").limit(TOXIC_BYTES // 2).collect()
    ]
    common = [
        bytes(r["word"]) for r in seen.where("b > 0").orderBy(F.desc("b"), "word")
        .limit(COMMON_BYTES).collect()
    ]
    seen.unpersist()
    first = _taken(common, COMMON_BYTES)
    toxic_words = _taken(marks, TOXIC_BYTES)
    filler = _taken(common[len(first):], sum(len(w) + 1 for w in toxic_words))
    model = ToxicityModel(
        _joined(filler) + _joined(first), _joined(toxic_words) + _joined(first), (0.0,) * (FIGURES + 1)
    )
    measured = with_figures(rows.where("calibrates"), model, ["doc_id", "toxic"]).orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in measured], float)
    if len(set(y.tolist())) < 2:  # nothing to compare: the rate of the class seen
        rate = (y.sum() + 1) / (len(y) + 2)
        weights = [math.log(rate / (1 - rate))] + [0.0] * FIGURES
    else:
        x = np.array([r["figures"] for r in measured], float)
        weight = np.array([1 / rates[int(r["toxic"]), True] for r in measured])
        weights = _logistic(x, y, weight / weight.mean()).tolist()
    return ToxicityModel(model.ordinary, model.toxic, tuple(weights))


def _value(model: ToxicityModel):
    linear = F.lit(model.weights[0])
    for i, w in enumerate(model.weights[1:]):
        linear = linear + F.col("figures")[i] * F.lit(w)
    return 1 / (1 + F.exp(-linear))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted: one row per input row, null and empty texts included.

    An empty text has no savings and gets the score of plain prose. Only doc_id and
    text are read; further columns, whatever their names, play no part.
    """
    return (
        with_figures(docs, model, ["doc_id"])
        .select("doc_id", _value(model).alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def accepted(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, unchanged, as often as they are given;
    columns may have any names. An empty table stays empty."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return with_figures(rows, model, ["row"]).where(_value(model) < 0.5).select("row.*")
