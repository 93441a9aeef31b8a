"""Token ids of documents in files, compressed by Re-Pair grammars.

Documents are tokenized in ascending doc_id order and gathered into shards of about
``SHARD_IDS`` ids. In each shard, frequent pairs of neighbouring symbols are replaced
by new symbols, for up to ``ROUNDS`` rounds or until no pair is frequent or the 16-bit
symbols are used up. A round replaces all pairs at least 1 / ``SHARE`` as frequent as
the most frequent one; where two overlap, the more frequent goes first. No pair reaches over the end of a
document, so each document is a stretch of symbols. A shard keeps its rules with
the lengths they expand to, so any range of ids is decoded from the symbols that cover
it.

File format: Parquet rows (part, number, n_ids, data) in the order of the documents;
``data`` is a shard: "RPG1", then little-endian uint32 base, rules, symbols, documents;
then left and right of each rule (uint16), its expansion length (uint32), the symbols
(uint16), and per document its id (int64), 1 if that is null (uint8) and the number of
its symbols (uint32). Symbols below base are token ids, base + k is rule k.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlens.llm.common import shared_root, text_or_empty

END = 2
SHARD_IDS = 1 << 20
LEAST = 4  # a pair that stands less often is no rule
ROUNDS = 6
SYMBOLS = 1 << 16
MOST_RULES = 1 << 15  # of one round
SHARE = 32
SLOT_BITS = 19
HASH, SHIFT = np.uint32(0x9E3779B1), np.uint32(32 - SLOT_BITS)
CACHED_WORDS = 1_000_000
SLICE_BYTES = 4 << 20
MAGIC = b"RPG1"


class WordCoder:
    """Text -> ids of a tokenizer that drops white space and lower-cases, as bytes
    (little-endian uint16), without the end id.

    White space separates tokens, and so does the place between an ASCII letter and a
    stop or comma, so words are encoded apart, once each, and remembered. Words of
    letters alone are handed over many at a time and parted again at the tokens that
    end a word. Texts with ``<|`` may hold special tokens, which are told apart by
    case: they are not lower-cased beforehand.
    """

    def __init__(self, path: str | None = None):
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        vocabulary = self.tool.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        # Lower-case ASCII letters pass the other steps of the tokenizer unchanged.
        self.letters = Tokenizer(self.tool.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[bytes, bytes] = {}
        self.tail = re.compile(rb"(?<=[a-z])[.,;:!?]+\Z")

    @staticmethod
    def _encoded(tool, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        ascii_, alpha, other = [], [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            kind = other if not text.isalpha() else ascii_ if w.isascii() and w.islower() else alpha
            kind.append((w, text))
        for tool, plain in ((self.letters, ascii_), (self.tool, alpha)):
            groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
            for group, ids in zip(groups, self._encoded(tool, [" ".join(t for _, t in g) for g in groups])):
                ends = (np.flatnonzero(self.ends[ids]) * 2 + 2).tolist()
                if len(ends) != len(group):
                    other += group
                    continue
                data = ids.tobytes()
                self.known.update((w, data[i:j]) for (w, _), i, j in zip(group, [0, *ends], ends))
        for (w, _), ids in zip(other, self._encoded(self.tool, [t for _, t in other])):
            self.known[w] = ids.tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Remembers the ids of the words; stops after a letter are words of their own."""
        parted = {w: m.start() for w in words if (m := self.tail.search(w)) and b"<|" not in w}
        parts = {p for w, i in parted.items() for p in (w[:i], w[i:])} | (words - parted.keys())
        self._learn(parts.difference(self.known))
        for w, i in parted.items():
            self.known[w] = self.known[w[:i]] + self.known[w[i:]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array; the distinct words of all of them are
        looked up, and learnt where they are new, once."""
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        parted = pc.ascii_split_whitespace(lowered)
        coded = parted.flatten().cast(pa.binary()).dictionary_encode()
        words, places = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        held = list(map(self.known.get, words))
        new = {w for w, ids in zip(words, held) if ids is None}
        if new:
            self.learn(new)
            held = [self.known[w] if ids is None else ids for w, ids in zip(words, held)]
        flat = np.frombuffer(b"".join(held), "<u2")
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 2
        starts = np.cumsum(sizes) - sizes
        each = sizes[places]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(starts[places] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[parted.offsets.to_numpy() - parted.offsets[0].as_py()]
        return [ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def __call__(self, text: bytes) -> bytes:
        return self.encode(pa.array([text.decode()], pa.string()))[0].tobytes()


def worker_coder(path: str | None) -> WordCoder:
    """The coder of this worker process, which outlives a task with the words it knows."""
    import sys
    import types

    held = sys.modules.setdefault("_held_word_coders", types.ModuleType("_held_word_coders")).__dict__
    if path not in held:
        held[path] = WordCoder(path)
    return held[path]


@dataclass
class Grammar:
    base: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray  # ids that each rule expands to

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rules = symbols >= self.base
        out[rules] = self.lengths[symbols[rules] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for, all symbols of one step at a time."""
        sizes = self.sizes(symbols)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint16)
        at, own = ends - sizes, symbols.astype(np.int64)
        while len(own):
            rules = own >= self.base
            out[at[~rules]] = own[~rules]
            at, own = at[rules], own[rules] - self.base
            left, right = self.left[own].astype(np.int64), self.right[own].astype(np.int64)
            at = np.concatenate([at, at + self.sizes(left)])
            own = np.concatenate([left, right])
        return out


def repair_pairs(ids: np.ndarray, last: np.ndarray, base: int, least: int = LEAST) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """(grammar, symbols, last) of ids below ``base``; ``last`` marks where documents end."""
    symbols, last = ids.astype(np.uint32), last.copy()
    lefts, rights, n_rules = [], [], 0
    slot_rank = np.empty(1 << SLOT_BITS, np.int16)
    for _ in range(ROUNDS):
        if len(symbols) < 2 or base + n_rules >= SYMBOLS:
            break
        keys = symbols[:-1] << np.uint32(16) | symbols[1:]
        ordered = np.sort(keys[~last[:-1]])
        if not len(ordered):
            break
        firsts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        counts = np.diff(np.r_[firsts, len(ordered)])
        frequent = np.flatnonzero(counts >= max(least, counts.max() // SHARE))
        if not len(frequent):
            break
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")][: min(SYMBOLS - base - n_rules, MOST_RULES)]
        pairs = ordered[firsts[frequent]]
        slots = pairs * HASH >> SHIFT
        slot_rank.fill(-1)
        slot_rank[slots[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int16)  # of one slot, the most frequent
        rank = slot_rank[keys * HASH >> SHIFT]
        rank[last[:-1]] = -1
        place = np.flatnonzero(rank >= 0)
        rank = rank[place]
        true = pairs[rank] == keys[place]
        place, rank = place[true], rank[true]
        if not len(place):
            break
        # The best of overlapping pairs; of a chain of equal ones every second.
        touch = np.diff(place) == 1
        chain = np.r_[True, ~touch | (rank[1:] != rank[:-1])]
        start = np.maximum.accumulate(np.where(chain, place, 0))
        wins = (place - start) % 2 == 0
        wins[1:] &= ~(touch & (rank[:-1] < rank[1:]))
        wins[:-1] &= ~(touch & (rank[1:] < rank[:-1]))
        chosen, rank = place[wins], rank[wins]
        used = np.bincount(rank, minlength=len(pairs)) >= 2
        if not used.any():
            break
        chosen, rank = chosen[used[rank]], rank[used[rank]]
        lefts.append(pairs[used] >> np.uint32(16))
        rights.append(pairs[used] & np.uint32(0xFFFF))
        number = np.cumsum(used) - 1 + base + n_rules
        n_rules += int(used.sum())
        symbols[chosen] = number[rank]
        last[chosen] = last[chosen + 1]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        symbols, last = symbols[keep], last[keep]
    left, right = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    grammar = Grammar(base, left, right, np.zeros(n_rules, np.int64))
    at = 0
    for part in lefts:  # rules of a round are made of earlier ones
        own = slice(at, at + len(part))
        grammar.lengths[own] = grammar.sizes(left[own]) + grammar.sizes(right[own])
        at += len(part)
    return grammar, symbols.astype(np.int64), last


def packed_shard(documents: list[np.ndarray], doc_ids: list[int | None], base: int) -> bytes:
    """A shard in the file format."""
    counts = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate(documents)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True  # every document has its end id
    grammar, symbols, last = repair_pairs(ids, last, base)
    each = np.diff(np.r_[0, np.flatnonzero(last) + 1])
    head = MAGIC + struct.pack("<4I", base, len(grammar.left), len(symbols), len(doc_ids))
    arrays = (
        grammar.left.astype("<u2"), grammar.right.astype("<u2"), grammar.lengths.astype("<u4"), symbols.astype("<u2"),
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), each.astype("<u4"),
    )
    return head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A shard read from its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no shard of token ids")
        base, rules, symbols, documents = struct.unpack_from("<4I", data, 4)
        at, arrays = 20, []
        for kind, n in (("<u2", rules), ("<u2", rules), ("<u4", rules), ("<u2", symbols), ("<i8", documents),
                        ("u1", documents), ("<u4", documents)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        left, right, lengths, self.symbols, ids, null, each = arrays
        self.grammar = Grammar(base, left, right, lengths)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.bounds = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])

    def documents(self) -> list[np.ndarray]:
        """The ids of each document."""
        ends = np.r_[0, np.cumsum(self.grammar.sizes(self.symbols))][self.bounds]
        ids = self.grammar.expand(self.symbols)
        return [ids[i:j] for i, j in zip(ends[:-1], ends[1:])]

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (not included) of the shard, from the symbols that cover them."""
        ends = np.cumsum(self.grammar.sizes(self.symbols))
        first, past = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[first - 1]) if first else 0
        return self.grammar.expand(self.symbols[first:past])[start - before : stop - before]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of about ``SLICE_BYTES`` of text at a time."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield batch.column("doc_id").slice(at, stop - at).to_pylist(), batch.column("text").slice(at, stop - at)
        at = stop


def _shards(path: str | None, shard_ids: int):
    names = ["part", "number", "n_ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = worker_coder(path), TaskContext.get().partitionId()
        end, number = np.array([END], "<u2"), 0
        documents, doc_ids, size = [], [], 0

        def shard():
            data = packed_shard(documents, doc_ids, coder.size)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()),
                 pa.array([data], pa.binary())], names,
            )

        for batch in batches:
            for own, texts in _slices(batch):
                for doc_id, ids in zip(own, coder.encode(texts)):
                    documents.append(np.concatenate([ids, end]))
                    doc_ids.append(doc_id)
                    size += len(documents[-1])
                    if size >= shard_ids:
                        yield shard()
                        documents, doc_ids, size, number = [], [], 0, number + 1
        if documents:
            yield shard()

    return run


def write_ids(docs: DataFrame, folder: str, path: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Writes the token ids of ``docs``, each document with the end id, to ``folder``.

    Null texts count as empty (their end id alone). Null ids come first; rows of one id
    stand in the order of a hash of their texts, so that one id with very many rows is
    dealt over tasks as well. A document is never parted: a shard is larger than
    ``shard_ids`` by less than its last document. Only doc_id and text are read. Ids and
    rules must fit in 16 bits; ``path`` names a tokenizer file of fewer than 65,536 ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(
        _shards(path, shard_ids), "part int, number int, n_ids long, data binary"
    ).write.parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, data in zip(*(batch.column(c) for c in ("part", "number", "data"))):
            shard = Shard(data.as_py())
            documents = shard.documents()
            counts = np.array([len(d) for d in documents], np.int64)
            n = len(documents)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32()),
                 pa.array(shard.doc_ids, pa.int64()), pa.array(np.cumsum(counts) - counts), pa.array(counts),
                 pa.array([d.astype("<u4").tobytes() for d in documents], pa.binary())],
                ["part", "number", "doc_id", "inside", "n_tokens", "ids"],
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) of each document in the files, with
    its place: part, number, inside."""
    return spark.read.parquet(folder).select("part", "number", "data").mapInArrow(
        _read, "part int, number int, doc_id long, inside long, n_tokens long, ids binary"
    )


def with_starts(documents: DataFrame, folder: str) -> DataFrame:
    """``documents`` with ``start``, the number of ids of all documents before, in the
    place of part, number and inside.

    Those are the ids of earlier parts, one row per task that wrote, then of earlier
    shards of the part, then of earlier documents of the shard. Columns that the caller
    has dropped or made smaller before are not shuffled.
    """
    sizes = documents.sparkSession.read.parquet(folder).select("part", "number", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(
        "part", before(Window.orderBy("part")).alias("parts_before")
    )
    starts = sizes.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("shards_before")).join(parts, "part")
    rest = [c for c in documents.columns if c not in ("part", "number", "inside", "doc_id")]
    return documents.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("parts_before") + F.col("shards_before") + F.col("inside")).alias("start"), *rest
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document in the files."""
    return with_starts(read_documents(spark, folder), folder)


def stored_folder(docs: DataFrame, path: str | None = None) -> str:
    """A new folder below the shared one that ``docs`` are written to. An empty table
    gives no rows when read."""
    import uuid

    folder = f"{shared_root(docs.sparkSession)}/llm-token-ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, path)
    return folder
