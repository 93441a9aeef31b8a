"""Sum-of-squares packing of tokenized documents into sequences.

A document longer than a sequence is cut from its end into full pieces; only the
first piece is shorter. Full pieces are sequences of their own. Every other piece is
placed by the sum-of-squares rule: of all open bins with room, and a new bin, take
the one after which the sum over gaps of (number of open bins with that gap) squared
is smallest. Pieces are dealt at random into groups of bounded expected size, each
packed by one call, the longest pieces first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlens.llm.common import text_or_empty, written

CAPACITY = 1024
GROUP_ITEMS = 3000  # expected pieces of a group
END = 2
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


def encoder(path: str | None = None):
    """text -> ids of the 50k byte-level vocabulary, as a numpy array.

    The rank file holds the same vocabulary as ``byte_bpe_50k.json`` and gives the
    same ids several times faster.
    """
    import base64

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tool = tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens={SPECIAL: SPECIAL_ID},
    )

    whole = []

    def encode(text: str) -> np.ndarray:
        special = {SPECIAL} if SPECIAL in text else set()
        try:
            return tool.encode_to_numpy(text, allowed_special=special, disallowed_special=())
        except ValueError:  # its pattern gives up on very long runs of white space
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity
    starts = list(range(first, n, capacity))
    return ([(0, first)] if first else []) + [(s, capacity) for s in starts]


def _pieces(capacity: int, with_ids: bool, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            rows, kinds = [], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), END).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    rows.append((doc_id, piece, start, length, zlib.crc32(data)) + (data,) * with_ids)
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids, as little-endian 32-bit
    numbers): at least one row per document; an empty or null text is its end id."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(_pieces(capacity, with_ids, path), schema)


def sum_of_squares(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, 1 to capacity, placed in the given order.

    With N(g) open bins of gap g, filling a gap g > s with s changes the sum by
    2 (N(g-s) - N(g)) + 2, closing a gap by 1 - 2 N(s), and a new bin (g = capacity)
    by 2 N(capacity-s) + 1. Ties go to the smallest gap.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)  # n[0], n[capacity] stay 0: closed and unopened
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths):
        gaps = n[s:]
        change = 2 * (n[: capacity - s + 1] - gaps) + 2
        change[0] -= 1
        change[gaps == 0] = 1 << 60
        if s < capacity:
            change[-1] = 2 * n[capacity - s] + 1
        else:
            change[-1] = 0
        g = s + int(change.argmin())
        if g == capacity:
            target, used = used, used + 1
        else:
            target = open_bins[g].pop()
            n[g] -= 1
        bins[i], offsets[i] = target, capacity - g
        if g > s:
            open_bins[g - s].append(target)
            n[g - s] += 1
    return bins, offsets


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each length, each put where the smallest gap is left."""
    import bisect

    gaps: list[tuple[int, int]] = []
    bins, used = np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths):
        at = bisect.bisect_left(gaps, (s, -1))
        if at < len(gaps):
            gap, target = gaps.pop(at)
        else:
            gap, target, used = capacity, used, used + 1
        bins[i] = target
        bisect.insort(gaps, (gap - s, target))
    return bins


def packed_bins(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each length (given longest first) by the sum-of-squares rule.

    The bins left with gaps are then dissolved and placed anew by the same rule for
    as long as that saves bins; what the last ones hold goes by best fit if that
    saves one.
    """
    bins = sum_of_squares(lengths.tolist(), capacity)[0]
    for rule in (lambda x: sum_of_squares(x, capacity)[0], lambda x: best_fit(x, capacity)):
        while True:
            fill = np.bincount(bins, weights=lengths).astype(np.int64)
            loose = np.flatnonzero(fill < capacity)
            items = np.flatnonzero(fill[bins] < capacity)
            anew = rule(lengths[items].tolist())
            if not len(items) or anew.max() + 1 >= len(loose):
                break
            bins = np.searchsorted(np.setdiff1d(np.arange(len(fill)), loose), bins)
            bins[items] = len(fill) - len(loose) + anew
    return bins


def _packed(capacity: int):
    def run(key, table):
        order = np.lexsort((table.column("uid").to_numpy(), -table.column("length").to_numpy()))
        table = table.take(pa.array(order))
        lengths = table.column("length").to_numpy()
        bins = packed_bins(lengths, capacity)
        by_bin = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[by_bin]) - lengths[by_bin]
        first = np.flatnonzero(np.diff(bins[by_bin], prepend=-1))
        offsets = np.empty(len(bins), np.int64)
        offsets[by_bin] = before - np.repeat(before[first], np.diff(np.r_[first, len(bins)]))
        return (
            table.drop_columns(["uid", "group"])
            .append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32)))
            .append_column("offset", pa.array(offsets))
        )

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``items`` (with a column length, 1 to capacity) plus sequence_id and offset.

    The rows are first written to the shared folder with a row number, which fixes
    the dealing into groups for any repeated task.
    """
    rows = written(items.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") == capacity)
    rest = rows.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_items))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("uid", F.lit("pack")), F.lit(groups)))
    fields = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    packed = dealt.groupBy("group").applyInArrow(_packed(capacity), f"{fields}, sequence_id long, offset long")
    alone = full.withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long")).drop("uid")
    return packed.unionByName(alone)


def sequences(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    Repeated rows are packed as documents of their own. An empty table gives no
    rows. Only doc_id and text are read, whatever further columns are called. A text is
    tokenized whole, however long; its pieces are rows of their own.
    """
    return pack(pieces(docs, capacity, with_ids, path), capacity)
