"""Runs: stretches of words that repeat with a period, by descending-LCP Kruskal.

A run with smallest period q is a stretch of at least two periods (and of ``LEAST``
words) that no neighbouring word extends. If it starts at s and has length m, the
suffixes at s and s + q have exactly m - q words in common, and no position between
the two shares that many with them. So the suffixes of a text are united into classes
by falling length of common prefix, as Kruskal's algorithm unites a forest by falling
weight: a union-find keeps each class with its ordered positions, the smaller class
is put into the larger, and two positions that become neighbours at a distance not
above the common prefix seed a run. A seed whose left neighbour still agrees is not
the start of its run and is passed over.

A run's two suffixes share at least LEAST / 2 words, so classes below that length are
never formed, and a text in which no LEAST / 2 words stand twice is done after one
sort. Texts are independent: nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens.llm.common import text_or_empty

LEAST = 12
INSERTED = 64  # up to so many positions are put into a class one by one
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                     0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first occurrence among the distinct words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def may_repeat(ids: np.ndarray, width: int) -> bool:
    """False if no ``width`` words stand twice; true if so, or if hashes collide."""
    n = len(ids) - width + 1
    if n < 2:
        return False
    values, keys = ids.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(width):
        keys = (keys ^ values[j : j + n]) * _FACTORS[j % len(_FACTORS)]
        keys ^= keys >> np.uint64(29)
    keys.sort()
    return bool((keys[1:] == keys[:-1]).any())


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the next one), by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, reach = [rank], 1
    while reach < n and int(levels[-1].max()) < n - 1:
        ahead = np.zeros(n, np.int64)  # 0: past the end
        ahead[: n - reach] = levels[-1][reach:] + 1
        levels.append(np.unique(levels[-1] * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64))
        reach *= 2
    order = np.argsort(levels[-1], kind="stable")
    i, j, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + common, j + common
        inside = np.maximum(a, b) < n
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        common[same] += 1 << k
    return order, common


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs, by start, then period."""
    width = -(-least // 2)
    if not may_repeat(ids, width):
        return []
    order, common = suffix_order(ids)
    joins = np.flatnonzero(common >= width)
    joins = joins[np.argsort(-common[joins], kind="stable")]
    members = np.unique(np.concatenate([joins, joins + 1]))
    classes: dict[int, list[int]] = {int(x): [int(order[x])] for x in members}
    parent = {int(x): int(x) for x in members}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    words, found = ids.tolist(), []

    def seed(p: int, q: int, shared: int) -> None:
        d = q - p
        if d <= shared and d + shared >= least and (p == 0 or words[p - 1] != words[q - 1]):
            found.append((p, d + shared, d))

    for x, shared in zip(joins.tolist(), common[joins].tolist()):
        a, b = root(x), root(x + 1)
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        large, small = classes[a], classes.pop(b)
        parent[b] = a
        places = [bisect(large, p) for p in small]
        for t, (p, k) in enumerate(zip(small, places)):
            if k and (not t or places[t - 1] < k):
                seed(large[k - 1], p, shared)
            if k < len(large) and (t + 1 == len(small) or places[t + 1] > k):
                seed(p, large[k], shared)
        if len(small) <= INSERTED:
            for t, (p, k) in enumerate(zip(small, places)):
                large.insert(k + t, p)
        else:
            large += small
            large.sort()
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _scanned(least: int):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_runs, left = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.split()  # of bytes: at exactly the six ASCII white spaces
                found = runs(numbered(words), least) if len(words) >= least else []
                if found:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                all_runs.append([{"start": s, "length": m, "period": p} for s, m, p in found])
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(all_runs, pa.list_(run)), pa.array(left, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"],
            )

    return scan


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), collapsed: one row
    per row of ``docs``.

    Words are white-space words (ASCII white space), compared with case, numbered from 0.
    ``collapsed`` holds the words that no run repeats, joined by one space. Null and
    empty texts have no runs and collapse to an empty text; null ids and repeated rows
    come back as given; an empty table gives no rows. A text is held whole, however
    long it is, with some hundred bytes for each of its words. Only doc_id and text are
    read, whatever further columns are called.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        _scanned(least), f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; texts of one id in ten go round in a loop from some word on.

    With h = crc32(doc_id as text) and g = floor(h / 10): if h is divisible by 10, each
    word i from a = g mod n on becomes word a + (i - a) mod p, where
    p = 1 + floor((n - a) / (3 + g mod 8)). Null ids are left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h")).select(
        "doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, split).alias("words")
    )

    def turned(words: Column, g: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.element_at(words, (F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i) + 1).cast("int"))
        )), " ")

    return rows.select("doc_id", F.when(F.size("words") > 0, turned(F.col("words"), F.col("g"))).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests, from the rows of ``periodic_runs``."""
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")
    ))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("r"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", F.col("r.start").alias("start"), (-F.col("r.shorter")).alias("length"), "r.period",
        F.floor(-F.col("r.shorter") * 1000 / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
