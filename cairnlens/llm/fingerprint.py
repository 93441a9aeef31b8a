"""Threshold-scaled sketches: all shingle hashes below a fixed fraction are kept.

The sketch of a text has about ``1 / FRACTION`` of its shingles, so sketches of
texts of very unequal length compare, merge (``merged``) and estimate containment.
Shingles are runs of five words (shorter texts: all their words). Hashes are the
first 16 hex digits of MD5, compared as text: the fraction is the share of hash
values below ``LIMIT``. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlens.functions.chunks import lead_value
from cairnlens.llm.common import text_or_empty

WORDS = 5
LIMIT = "4000000000000000"  # hashes below: a quarter of all values
CHUNK = 256  # consecutive ids that share a window partition
LOWEST = -(1 << 62)  # stands for a null id in orders

_SPACE = r"[\x09-\x0D\x20]+"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, not once per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shingles(words: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - (WORDS - 1), F.lit(1))),
        lambda i: F.array_join(F.slice(words, i, WORDS), " "),
    )


def _kept(hashes: Column) -> Column:
    below = F.filter(hashes, lambda h: h < LIMIT)
    return _bound(below, lambda b: F.when(F.size(b) > 0, F.array_sort(b)).otherwise(F.array(F.array_min(hashes))))


def sketch(text: Column) -> Column:
    """Sorted distinct kept hashes; of a text of fewer than five words, all its words
    make one shingle. A text whose hashes all lie above the limit keeps its smallest
    one, so that only texts without words have an empty sketch."""
    words = F.array_remove(F.split(text, _SPACE), "")
    return _bound(words, lambda w: F.when(F.size(w) > 0, _bound(
        F.array_distinct(F.transform(_shingles(w), lambda s: F.substring(F.md5(s), 1, 16))), _kept
    )).otherwise(F.array().cast("array<string>")))


def merged(sketches: Column) -> Column:
    """The sketch of all shingles of several texts, from the array of their sketches.

    It is the one that the texts' shingles taken together would give: the kept hashes
    are those that any text kept; only if no text has a hash below the limit is it the
    smallest of the smallest ones. So merging in any order and grouping agrees.
    """
    every = F.array_distinct(F.flatten(sketches))
    return _bound(every, lambda e: F.when(F.size(e) > 0, _kept(e)).otherwise(e))


def merge_sketches(rows: DataFrame, keys: list[str], column: str = "sketch") -> DataFrame:
    """keys and the merged sketch of their rows. Hashes meet one by one, map-side first;
    a group is held as its distinct kept hashes. Groups of empty sketches stay, empty."""
    values = rows.select(*keys, F.explode_outer(column).alias("_hash"))
    kept = F.array_sort(F.collect_set(F.when(F.col("_hash") < LIMIT, F.col("_hash"))))
    smallest = F.array_compact(F.array(F.min("_hash")))
    return values.groupBy(*keys).agg(kept.alias("_kept"), smallest.alias("_smallest")).select(
        *keys, F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_smallest")).alias(column)
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike (1)."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, 1.0).otherwise(common / every).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; an empty a is contained (1)."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch and next_text, next_sketch: the next document's.

    Order is (doc_id, text), null ids first; after the last comes the first, so a
    single document follows itself. Documents are windowed in chunks of neighbouring
    ids; the first document of the next chunk joins each chunk as one more row, so
    no order runs through a single task. Repeated rows follow each other.
    """
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn(
        "chunk", F.coalesce(F.floor(F.col("doc_id") / CHUNK).cast("bigint"), F.lit(LOWEST))
    )
    key = F.struct(F.coalesce("doc_id", F.lit(LOWEST)).alias("i"), F.col("text").alias("t"))
    firsts = base.groupBy("chunk").agg(F.min(key).alias("first"))
    chunks = base.select("chunk").distinct()
    after = lead_value(chunks, [], "chunk", "chunk", "after", span=1 << 16)
    lowest = chunks.agg(F.min("chunk")).first()[0]
    if lowest is None:
        lowest = LOWEST
    after = after.withColumn("after", F.coalesce("after", F.lit(lowest)))
    carried = after.join(
        firsts.select(F.col("chunk").alias("after"), "first"), "after"
    ).select(F.col("first.i").alias("doc_id"), F.col("first.t").alias("text"), "chunk", F.lit(1).alias("carried"))
    rows = (
        base.withColumn("carried", F.lit(0)).unionByName(carried).repartition("chunk")
        .select("*", sketch(F.col("text")).alias("sketch"))
    )
    order = Window.partitionBy("chunk").orderBy("carried", F.asc_nulls_first("doc_id"), "text")
    return (
        rows.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_sketch", F.lead("sketch").over(order))
        .where("carried = 0").drop("carried", "chunk")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: sketches of the text and of its edited text.

    The edited text has its last quarter (rounded down) replaced by as many leading
    code points of the next document. Null texts count as empty; extra columns are
    not read; an empty table gives no rows. Texts are taken whole, however long.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - quarter)"), F.expr("substring(next_text, 1, quarter)"))
    return (
        with_next(docs).withColumn("n_chars", n).withColumn("quarter", quarter)
        .withColumn("edited", edited).drop("next_text", "text", "quarter")
        .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
        .withColumn("edited_sketch", sketch(F.col("edited"))).drop("edited")
        .select(
            "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256",
            "sketch", "edited_sketch",
            likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
            likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
            containment(F.col("sketch"), F.col("edited_sketch")).alias("held_edited"),
        )
    )
