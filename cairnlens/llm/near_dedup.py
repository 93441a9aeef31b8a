"""Near-duplicate documents by Order MinHash and banded alignment.

Equal texts are one node with a number. Each node gets ``SKETCHES`` order-min-hash
values: of its occurrence-labelled k-mers of words, the smallest under one hash
function, ``PICKED`` of each length, kept in text order. Unlike plain MinHash this
feels moved and repeated passages; short k-mers are left even where every fifth word is
another one, and single words tell texts that are similar as a whole from those that
share a passage: if it fills a third of both, one sketch in a thousand agrees. Texts
of at most ``SHORT`` words, of which one change can touch many k-mers, also get a value
for each text that is left when as many words are deleted as the similarity allows:
two short texts that are similar have one of these in common with certainty. Nodes that
share a value meet in a bucket. A bucket is not paired off: each node is aligned with
the smallest of its buckets' first nodes, classes are formed, and it is aligned with
those other first nodes that are still in another class. Only nodes of one bucket that
are still in different classes are then aligned with each other, if their lengths and
the words they have in common allow similarity.

Similarity of two texts: 1 - (word edit distance) / (words of the longer one).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens.llm.common import mix, shingle_hashes, text_or_empty, word_hashes, written

SIMILARITY = 0.8
SKETCHES = 36  # texts of which every fifth word is another one meet with 0.95
PICKED = (4, 1)  # single words, and word pairs
SHORT = 15
FIRST_BAND = 8
BATCH_CELLS = 1 << 21
BITS = 512


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by their occurrence number in the text."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))
    occurrence = np.empty(len(ordered), np.uint64)
    occurrence[order] = (np.arange(len(ordered)) - first).astype(np.uint64)
    return mix(shingles + occurrence * np.uint64(0xD6E8FEB86659FD93))


def _lowest(keys: np.ndarray, factors: np.ndarray, picked: int) -> np.ndarray:
    """Places of the ``picked`` smallest keys under each hash function, in text order."""
    n = min(picked, len(keys))
    values = keys[None, :] * factors[:, None]  # each row orders the keys anew
    values ^= values >> np.uint64(32)
    values *= factors[:, None]
    if n == len(keys):
        return np.tile(np.arange(n), (len(factors), 1))
    if n == 1:
        return values.argmin(axis=1)[:, None]
    return np.sort(np.argpartition(values, n - 1, axis=1)[:, :n], axis=1)


def order_min_hashes(words: np.ndarray, sketches: int = SKETCHES, picked: tuple[int, ...] = PICKED) -> np.ndarray:
    """One value per sketch, of ``picked[k - 1]`` k-mers for each k; none for a text
    without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    out = factors
    for k, count in enumerate(picked, 1):
        keys = labelled(shingle_hashes(words, k))
        for column in _lowest(keys, factors, count).T:  # text order
            out = mix(out * np.uint64(31) + keys[column])
    return out


def word_bits(words: np.ndarray) -> np.ndarray:
    """``BITS`` bits as 64-bit numbers; a word sets the bit that its hash names."""
    bits = np.zeros(BITS, bool)
    bits[(words % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).view("<i8")


def left_over(n: int, similarity: float) -> tuple[np.ndarray, ...]:
    """Places of the words that stay, one array per number of words.

    If the longer of two texts has m words and d changes are allowed, they have m - d
    words in common, in order; so both emit all their parts of that many words.
    """
    limit = lambda m: int(np.floor((1 - similarity) * m + 1e-9))
    sizes = {m - limit(m) for m in range(n, SHORT + 1) if m - n <= limit(m)}
    return tuple(np.array(list(itertools.combinations(range(n), t)), np.int64) for t in sorted(sizes) if 0 < t <= n)


def short_keys(words: np.ndarray, similarity: float = SIMILARITY, places: dict | None = None) -> np.ndarray:
    """Values of the parts of a short text; none for a longer one or one without words.

    ``places`` keeps what ``left_over`` gave for each length.
    """
    if not 0 < len(words) <= SHORT:
        return np.zeros(0, np.uint64)
    places = {} if places is None else places
    if len(words) not in places:
        places[len(words)] = left_over(len(words), similarity)
    found = []
    for kept in places[len(words)]:
        out = np.full(len(kept), kept.shape[1], np.uint64)
        for column in kept.T:
            out = mix(out * np.uint64(31) + words[column])
        found.append(np.unique(out))
    return np.concatenate(found)


def _sketched(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict = {}
        with np.errstate(over="ignore"):
            for batch in batches:
                values, counts = [], []
                for text in batch.column("text").to_pylist():
                    words = word_hashes(text.encode("utf-8", "surrogatepass"))[0]
                    counts.append(len(words))
                    keys = np.concatenate([order_min_hashes(words), short_keys(words, similarity, places)])
                    values.append(np.unique(keys).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("digest"), pa.array(counts, pa.int32()),
                     pa.array(values, pa.list_(pa.int64()))],
                    ["doc_id", "digest", "n", "keys"],
                )

    return run


def _word_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as 32-bit numbers; unlike words agree with probability 2**-32."""
    with np.errstate(over="ignore"):
        for batch in batches:
            data = [
                (word_hashes(t.encode("utf-8", "surrogatepass"))[0] >> np.uint64(32)).astype("<u4").tobytes()
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(data, pa.binary())], ["node", "words"])


def _word_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their occurrence numbers as 32-bit numbers, and the bit map of these."""
    with np.errstate(over="ignore"):
        for batch in batches:
            marks = [labelled(np.frombuffer(w.as_buffer(), "<u4").astype(np.uint64)) for w in batch.column("words")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([word_bits(m) for m in marks], pa.list_(pa.int64())),
                 pa.array([m.astype(np.uint32).view(np.int32) for m in marks], pa.list_(pa.int32()))],
                ["node", "bits", "marks"],
            )


def _band_distances(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Cost of the best alignment of each pair that stays within ``band`` of the main
    diagonal: the edit distance, or more if the best one leaves the band.

    All pairs advance together, a word of the first text at a time. Column k stands
    for word i + k - band of the second text and holds the cost less k, so that a
    step along the row is a running minimum.
    """
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, width = int(n.max(initial=0)), 2 * band + 1
    a = np.zeros((len(pairs), rows), np.uint32)
    b = np.zeros((len(pairs), band + max(rows, int(m.max(initial=0))) + band + 1), np.uint32)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        b[i, band : band + len(y)] = y
    far = 1 << 28
    start = np.where(np.arange(width) >= band, -band, far).astype(np.int32)
    row = np.tile(start, (len(pairs), 1))
    result = np.full(len(pairs), far, np.int64)
    by_length = np.argsort(n, kind="stable")
    ends = np.searchsorted(n[by_length], np.arange(rows + 2))

    def note(i: int) -> None:
        done = by_length[ends[i] : ends[i + 1]]
        if len(done):
            place = m[done] - i + band
            ok = (place >= 0) & (place < width)
            result[done[ok]] = row[done[ok], place[ok]] + place[ok]

    note(0)
    for i in range(1, rows + 1):
        anew = row + (b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        np.minimum(anew[:, :-1], row[:, 1:] + 2, out=anew[:, :-1])
        if i <= band:  # columns before the second text, and its empty beginning
            anew[:, : band - i] = far
            anew[:, band - i] = i - (band - i)
        row = np.minimum.accumulate(anew, axis=1)
        note(i)
    return result


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words that both hold, counted as often as both hold them."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether each pair of word arrays reaches the similarity, exactly.

    Common ends are cut off. Pairs with too few words in common, in any order, are
    refused at once. A narrow band is tried first; what it cannot accept gets wider
    bands up to the largest distance that counts.
    """
    answer, todo = np.zeros(len(pairs), bool), []
    for i, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        limit = int(np.floor((1 - similarity) * longer + 1e-9))
        short = min(len(a), len(b))
        if longer - short > limit:
            continue
        same = a[:short] == b[:short]
        head = short if same.all() else int(same.argmin())
        a, b = a[head:], b[head:]
        short = min(len(a), len(b))
        same = a[len(a) - short :][::-1] == b[len(b) - short :][::-1]
        tail = short if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if max(len(a), len(b)) <= limit:
            answer[i] = True
        elif max(len(a), len(b)) - common_words(a, b) <= limit:
            todo.append((i, limit, a, b))
    band = FIRST_BAND
    while todo:
        todo.sort(key=lambda t: len(t[2]))
        rest, at = [], 0
        while at < len(todo):
            end = at + 1
            while end < len(todo) and (end - at + 1) * (len(todo[end][2]) + 4 * band + 2) <= BATCH_CELLS:
                end += 1
            part = todo[at:end]
            costs = _band_distances([(a, b) for _, _, a, b in part], band)
            for item, cost in zip(part, costs):
                if cost <= item[1]:
                    answer[item[0]] = True
                elif band < item[1]:
                    rest.append(item)
            at = end
        todo, band = rest, band * 4
    return answer


def _digest(column: str) -> Column:
    return F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [
                (np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4"))
                for a, b in zip(batch.column("words"), batch.column("other_words"))
            ]
            keep = pa.array(similar(pairs, similarity))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").filter(keep), batch.column("other").filter(keep)], ["node", "other"]
            )

    return run


def _length_allows(n: str, m: str, similarity: float) -> Column:
    """Whether texts of so many words can be similar enough."""
    longer = F.greatest(F.col(n), F.col(m))
    return longer - F.least(F.col(n), F.col(m)) <= (1 - similarity) * longer + 1e-9


def _words_allow(a: str, b: str, n: str, m: str, similarity: float) -> Column:
    """Whether the words of each text that the other lacks are few enough: each takes a
    change, and a bit that one has and the other has not stands for at least one."""
    allowed = (1 - similarity) * F.greatest(F.col(n), F.col(m)) + 1e-9

    def lacking(x: str, y: str) -> Column:
        parts = [F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BITS // 64)]
        return sum(parts[1:], parts[0])

    return (lacking(a, b) <= allowed) & (lacking(b, a) <= allowed)


def _marks_allow(a: str, b: str, n: str, m: str, similarity: float) -> Column:
    """The same by the marks, which do not run full as the bits do in a long text: a word
    counts as often as it occurs, as in the edit distance."""
    longer = F.greatest(F.col(n), F.col(m))
    return longer - F.size(F.array_intersect(a, b)) <= (1 - similarity) * longer + 1e-9


def aligned(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, other) that are similar."""
    texts = pairs.join(words, "node").join(
        words.select(F.col("node").alias("other"), F.col("words").alias("other_words")), "other"
    )
    return texts.select("node", "other", "words", "other_words").mapInArrow(_verified(similarity), "node long, other long")


def classes(links: DataFrame) -> DataFrame:
    """node, class of the linked nodes: the smallest node that links lead to.

    Each round takes the smallest class of all neighbours, later rounds also the class
    of that class, which shortens chains. Rounds are written; the first without a
    change is the last.
    """
    both = written(links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("class"))
    for number in itertools.count():
        if number > 2:
            step = labels.select(F.col("node").alias("class"), F.col("class").alias("next"))
            labels = labels.join(step, "class").select("node", F.col("next").alias("class"))
        labels = written(labels, "classes")
        near = both.join(labels.select(F.col("node").alias("other"), "class"), "other").select(
            "node", "class", F.lit(None).cast("long").alias("was")
        )
        after = written(
            near.unionByName(labels.withColumn("was", F.col("class"))).groupBy("node")
            .agg(F.min("class").alias("class"), F.max("was").alias("was")), "classes",
        )
        labels = after.select("node", "class")
        if after.where("class <> was").isEmpty():
            return labels


def assigned(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, class (a node number), n_links: one row per row of ``docs``."""
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", _digest("text"))
    sketched = written(
        texts.mapInArrow(_sketched(similarity), f"doc_id {dict(docs.dtypes)['doc_id']}, digest string, n int, keys array<bigint>"),
        "sketches",
    )
    # Distinct texts are numbered once and written, so that rows that are shuffled hold
    # a number for a text.
    nodes = written(
        sketched.groupBy("digest").agg(F.first("keys").alias("keys"), F.first("n").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes",
    )
    entries = nodes.select("node", "n", F.explode("keys").alias("key"))
    leader = F.min(F.struct("node", "n")).alias("leader")
    first = entries.groupBy("key").agg(leader, F.count("*").alias("size")).where("size > 1")
    met = written(entries.join(first.drop("size"), "key"), "buckets")
    numbers = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "digest")
    words = written(
        texts.dropDuplicates(["digest"]).join(numbers, "digest")
        .select("node", "text").mapInArrow(_word_numbers, "node long, words binary"), "words",
    )
    stars = met.where("node <> leader.node").where(_length_allows("n", "leader.n", similarity)).select(
        "node", F.col("leader.node").alias("other")
    ).distinct()
    stars = written(stars, "stars")
    # Each node meets one leader first; in a large group most others are then in its class.
    first = stars.groupBy("node").agg(F.min("other").alias("other"))
    links = written(aligned(first, words, similarity), "links")
    labels = classes(links)
    own, others = labels.select("node", "class"), labels.select(F.col("node").alias("other"), F.col("class").alias("other_class"))
    rest = (
        stars.join(first, ["node", "other"], "left_anti").join(own, "node", "left").join(others, "other", "left")
        .where(F.coalesce("class", "node") != F.coalesce("other_class", "other")).select("node", "other")
    )
    links = written(links.unionByName(aligned(rest, words, similarity)), "links")
    # Buckets that still hold several classes: their nodes meet across classes.
    marked = met.select("node", "n", "key").join(classes(links), "node", "left").withColumn(
        "class", F.coalesce("class", "node")
    )
    mixed = marked.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("key")
    open_ = written(marked.join(mixed, "key", "left_semi"), "open")
    marks = words.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(
        _word_marks, "node long, bits array<bigint>, marks array<int>"
    )
    open_ = written(open_.join(marks, "node"), "open-marks")
    others = open_.select(
        "key", F.col("node").alias("other"), F.col("class").alias("other_class"), F.col("n").alias("m"),
        F.col("bits").alias("other_bits"), F.col("marks").alias("other_marks"),
    )
    tested = stars.select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other"))
    crossing = (
        open_.join(others, (open_["key"] == others["key"]) & (F.col("class") != F.col("other_class"))
                   & (F.col("node") < F.col("other")) & _length_allows("n", "m", similarity)
                   & _words_allow("bits", "other_bits", "n", "m", similarity)
                   & _marks_allow("marks", "other_marks", "n", "m", similarity))
        .select("node", "other").distinct().join(tested, ["node", "other"], "left_anti")
    )
    links = written(links.unionByName(aligned(crossing, words, similarity)), "links")
    labels = classes(links)
    degree = (
        links.select("node").unionByName(links.select(F.col("other").alias("node")))
        .groupBy("node").agg(F.count("*").alias("n_links"))
    )
    found = nodes.select("digest", "node").join(labels, "node", "left").join(degree, "node", "left").select(
        "digest", F.coalesce("class", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return sketched.select("doc_id", "digest").join(found, "digest")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links: one row per row of ``docs``.

    class_id is the smallest doc_id of the class (null if all its ids are null);
    n_links counts the links used to form the class that end at the document's text;
    similar texts that were already in one class are not aligned, so it is no count of
    all similar texts. Equal texts share a class whatever their length; null counts as
    empty text, and empty texts are one class. Repeated rows come back as often as
    they are given. Further columns are not read.
    """
    found = assigned(docs, similarity)
    smallest = found.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return found.join(smallest, "class").select("doc_id", "class_id", "n_links")


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: the smallest doc_id (null last), then the smallest MD5
    of the text; of equal rows one. Columns of ``docs`` may have any names."""
    found = written(assigned(docs, similarity), "assigned")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    keep = written(found.groupBy("class").agg(F.min(place).alias("k")).select("k.doc_id", "k.digest"), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), _digest("text").alias("digest"))
    kept = rows.join(
        keep, rows["doc_id"].eqNullSafe(keep["doc_id"]) & (rows["digest"] == keep["digest"]), "left_semi"
    )
    if not found.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select("row.*")
