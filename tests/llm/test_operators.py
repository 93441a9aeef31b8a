"""Corpus operators against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlens.llm import (
    fingerprint, language_model, licenses, mixing, near_dedup, packing, passages, queries, topk,
    toxicity, url_filter,
)
from compare import differences

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(n)]


def table(spark, texts, schema=DOC):
    rows = [
        (i, t, "en" if (i or 0) % 3 else "de", f"src{(i or 0) % 5}", None if t is None else len(t))
        for i, t in texts
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank and very long texts, copies, a repeated row, clashing names."""
    base = words(300, 1)
    near = list(base)
    near[50], near[200] = "changed", "other"
    texts = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, ""), (6, "  \n\t "),
        (7, "one"), (8, " ".join(words(20000, 2))), (8, " ".join(words(20000, 2))), (None, "no id here"),
        (9, "MIT License and the General Public License."), (10, "x" * 5000),
        (11, "é" * 40 + " <|endoftext|> tail"), (12, " ".join(words(120, 3) + base[100:180] + words(90, 4))),
    ]
    df = table(spark, texts)
    names = ["figures", "digest", "class", "uid", "group", "v", "key", "chunk", "rank", "place", "words", "spans"]
    return df.select("*", *[F.lit(1).alias(n) for n in names if n != "figures"])


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_matches_sql(spark, con, folder, name):
    assert differences(queries.QUERIES[name](spark, folder), con, queries.ORACLE_SQL[name]) == ""


# --- toxicity ---------------------------------------------------------------


def test_toxicity_finds_marked_words(spark):
    draw = random.Random(5)
    rows, marks = [], []
    for i in range(600):
        text = words(80, i)
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            text[draw.randrange(80)] = draw.choice(["slurword", "hatefulness", "nastything"])
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(toxic)))
    docs, labels = table(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    right = sum(found[i] == toxic for i, _, toxic in marks)
    assert right >= 580
    assert toxicity.accepted(docs, model).columns == docs.columns


def test_toxicity_without_labels_and_awkward_rows(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(awkward, none)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and {r["score"] for r in rows} == {0.5}
    assert toxicity.score(awkward.limit(0), model).count() == 0


# --- language model ---------------------------------------------------------


def test_gradients_match_differences():
    vocab = language_model.Vocabulary(
        [bytes([97 + i]) for i in range(6)] + [b"", b" "], np.arange(9, 1, -1), np.array([0, 1, 4, 8]), 50, 8, 5.0
    )
    draw = np.random.default_rng(0)
    network = language_model.Network(vocab, hidden=4)
    states, targets = draw.standard_normal((20, 4)), draw.integers(0, 8, 20)
    network.class_weights = draw.standard_normal(network.class_weights.shape)
    network.word_weights = draw.standard_normal(network.word_weights.shape)
    grads = {}
    network.log_likelihood(states, targets, grads)
    for i, j in ((0, 0), (3, 2)):
        moved = states.copy()
        moved[i, j] += 1e-5
        change = network.log_likelihood(states, targets).sum() - network.log_likelihood(moved, targets).sum()
        assert abs(change / 1e-5 - grads["states"][i, j]) < 1e-3
    # Probabilities of all words sum to one.
    one = np.repeat(states[:1], 8, 0)
    assert abs(np.exp(network.log_likelihood(one, np.arange(8))).sum() - 1) < 1e-6


def test_language_model_base_by_brute_force(spark, awkward):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    def remainder(i):
        import zlib
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = Counter(w for i, t in rows if remainder(i) != 2 for w in language_model.tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = sorted(
        (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4))
        for r in language_model.log_likelihoods(awkward).collect()
    )
    want = sorted(
        (str(i), len(w := language_model.tokens(t)), sum(counts[x] > 0 for x in w),
         round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4))
        for i, t in rows
    )
    assert got == want


def test_language_model_learns_and_carries_state(spark):
    draw = random.Random(3)
    texts = []
    for i in range(400):
        text = []
        for _ in range(60):
            k = draw.randrange(20)
            text += [f"a{k}", f"b{k}"]
        texts.append((i, " ".join(text)))
    rows = language_model.log_likelihoods(table(spark, texts)).collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    vocab = language_model.Vocabulary([b"a", b"b", b"", b" "], np.array([5, 4, 2, 1]), np.array([0, 2, 4]), 12, 4, 2.0)
    network = language_model.Network(vocab)
    long = np.array([0, 1] * 200 + [2], np.int32)
    alone = language_model.document_scores(network, [long], 2)[0]
    together = language_model.document_scores(network, [long[:9], long, long[:50]], 2)[1]
    assert abs(alone - together) < 1e-3


def test_every_training_document_is_in_one_round(spark):
    docs = table(spark, [(i, "a b") for i in range(500)])
    rounds = [language_model.round_documents(docs, k).collect() for k in range(language_model.ROUNDS)]
    assert sorted(r["doc_id"] for rows in rounds for r in rows) == list(range(500))
    assert all(rounds)


# --- near duplicates --------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment_is_exact():
    draw = random.Random(11)
    pairs = []
    for _ in range(200):
        a = [draw.randrange(6) for _ in range(draw.randint(0, 40))]
        b = list(a)
        for _ in range(draw.randint(0, 12)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 2)] = [draw.randrange(6) for _ in range(draw.randint(0, 2))]
        pairs.append((np.array(a, np.int64), np.array(b, np.int64)))
    want = [edit_distance(a, b) <= (1 - 0.8) * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert near_dedup.similar(pairs).tolist() == want


def test_near_duplicates_against_all_pairs(spark, awkward):
    extra = []
    for g in range(6):
        base = words(200, 100 + g)
        for c in range(5):
            copy = list(base)
            for _ in range(4):
                copy[random.Random(g * 10 + c).randrange(200)] = f"w{g}{c}"
            extra.append((100 + g * 10 + c, " ".join(copy)))
    docs = awkward.select("doc_id", "text").unionByName(table(spark, extra).select("doc_id", "text"))
    rows = docs.collect()
    parent = list(range(len(rows)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    split = [(r["text"] or "").lower().split() for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i]["text"] or "") == (rows[j]["text"] or "")
            n = max(len(split[i]), len(split[j]))
            if same or (split[i] and split[j] and abs(len(split[i]) - len(split[j])) <= 0.2 * n
                        and n < 1000 and edit_distance(split[i], split[j]) <= 0.2 * n + 1e-9):
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r["doc_id"])
    want = sorted((str(d), str(min((x for x in g if x is not None), default=None))) for g in groups.values() for d in g)
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dedup.near_duplicates(docs).collect())
    assert got == want
    kept = near_dedup.without_near_duplicates(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({b for _, b in want})
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_scattered_replacements_are_near_duplicates(spark):
    draw, texts = random.Random(8), []
    for i in range(40):
        base = words(200, 5000 + i)
        near = ["changed" if draw.random() < (0.05, 0.1)[i % 2] else w for w in base]
        texts += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    rows = near_dedup.near_duplicates(table(spark, texts)).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {d: d - d % 2 for d in range(80)}


def test_short_texts_against_all_pairs(spark):
    draw, texts = random.Random(9), []
    for n in range(1, 16):
        for i in range(3):
            base = words(n, 7000 + 10 * n + i)
            more, less, other = list(base), list(base), list(base)
            more.insert(draw.randrange(n + 1), "more")
            del less[draw.randrange(n)]
            other[draw.randrange(n)] = "other"
            texts += [t for t in (base, more, less, other) if 0 < len(t) <= 15]
    rows = list(enumerate(texts))
    parent = list(range(len(rows)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in rows:
        for j, b in rows[:i]:
            n = max(len(a), len(b))
            if abs(len(a) - len(b)) <= 0.2 * n and edit_distance(a, b) <= 0.2 * n + 1e-9:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = near_dedup.near_duplicates(table(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: root(i) for i, _ in rows}


# --- packing ----------------------------------------------------------------


def test_packing_round_trip(spark, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.sequences(awkward, with_ids=True).collect()
    whole = {}
    for r in rows:
        whole.setdefault(str(r["doc_id"]), set()).add((r["piece"], r["start"], bytes(r["ids"])))
    for r in awkward.collect():
        parts = sorted(whole[str(r["doc_id"])])
        ids = np.frombuffer(b"".join(p[2] for p in parts), "<u4").tolist()
        assert ids == reader.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert all(len(p[2]) == 4096 for p in parts[1:])
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.sequences(awkward.limit(0)).count() == 0


def test_sum_of_squares_rule():
    draw = random.Random(2)
    lengths = [draw.randint(1, 50) for _ in range(300)]
    bins, _ = packing.sum_of_squares(lengths, 50)
    gaps = {}
    for i, s in enumerate(lengths):  # the choice has the least sum among all choices
        def after(target):
            counts = Counter({**gaps, target: gaps.get(target, 50) - s}.values())
            return sum(n * n for g, n in counts.items() if 0 < g < 50)
        options = [b for b, g in gaps.items() if g >= s] + [-1]
        best = min(after(b) for b in options)
        chosen = int(bins[i])
        assert after(chosen if chosen in gaps else -1) == best
        gaps[chosen] = gaps.get(chosen, 50) - s
    packed = packing.packed_bins(np.array(sorted(lengths, reverse=True)), 50)
    assert np.bincount(packed, weights=sorted(lengths, reverse=True)).max() <= 50
    assert packed.max() + 1 <= bins.max() + 1


# --- passages ---------------------------------------------------------------


def test_compact_windows_cover_each_run_once():
    values = np.random.default_rng(4).integers(0, 40, 60).astype(np.uint64)
    windows = list(zip(*passages.compact_windows(values, 5)))
    for i in range(60):
        for j in range(i + 4, 60):
            holding = [c for l, c, r in windows if l <= i <= c <= j <= r]
            assert holding == [i + int(values[i : j + 1].argmin())]


def test_repeated_passages_are_found_and_cut(spark, awkward):
    rows = [r for r in passages.repeated(awkward).collect() if r["doc_id"] == 12]
    assert any(r["first_word"] == 120 and r["last_word"] == 199 and r["source_first_word"] == 100 for r in rows)
    kept = passages.without_repeats(awkward)
    assert kept.columns == awkward.columns
    texts = {r["doc_id"]: r for r in kept.collect()}
    assert 3 not in texts and texts[1]["text"] == " ".join(words(300, 1))
    assert texts[12]["text"].split() == words(120, 3) + words(90, 4)
    assert texts[12]["n_chars"] == len(texts[12]["text"])
    assert texts[4]["text"] is None and texts[5]["text"] == "" and None in texts
    assert passages.without_repeats(awkward.limit(0)).count() == 0


def _stretch_pairs(rows):
    return {(r["doc_id"], r["source_id"]) for r in rows}


def test_repeats_behind_common_lines_of_earlier_documents(spark):
    a, b, texts = words(30, 11), words(30, 12), []
    for i in range(6):  # documents 1 to 6 hold one half each, in surroundings of their own
        half = a if i % 2 else b
        texts.append((i + 1, " ".join(words(60, 100 + i) + half + words(60, 200 + i))))
    texts += [(20, " ".join(words(70, 301) + a + b + words(50, 302))), (21, " ".join(words(40, 303) + a + b + words(80, 304)))]
    rows = passages.repeated(table(spark, texts)).collect()
    assert _stretch_pairs(rows) == {(21, 20)}
    assert {(r["first_word"], r["last_word"], r["source_first_word"]) for r in rows} == {(40, 99, 70)}


def test_stretches_across_indels_and_scattered_changes():
    base = np.arange(60, dtype=np.uint32)
    inserted = np.insert(base, 30, 999).astype(np.uint32)
    assert passages.matching_stretches(inserted, base) == [(0, 60, 0, 60)]
    changed = base.copy()
    changed[[30, 34]] = 998, 999  # 30 equal, 1 changed, 3 equal, 1 changed, 25 equal
    assert passages.matching_stretches(changed, base) == [(0, 59, 0, 58)]
    assert passages.matching_stretches(np.arange(100, 160, dtype=np.uint32), base) == []
    for lost in (10, 14):  # 0.8 of the words, and less
        worse = base[:50].copy()
        worse[np.linspace(1, 48, lost).astype(int)] += 500
        assert bool(passages.matching_stretches(worse, base[:50])) == (lost == 10)


def test_near_passages_are_found(spark):
    draw, texts = random.Random(3), []
    for i in range(40):
        passage = words(60, 1000 + i)
        near = passage[:30] + ["new"] + passage[30:] if i % 2 else [
            "changed" if draw.random() < 0.1 else w for w in passage]
        texts += [(2 * i, " ".join(words(60, 2000 + i) + passage)), (2 * i + 1, " ".join(near + words(60, 3000 + i)))]
    found = _stretch_pairs(passages.repeated(table(spark, texts)).collect())
    assert found <= {(2 * i + 1, 2 * i) for i in range(40)} and len(found) >= 38


# --- mixing -----------------------------------------------------------------


def test_mixing_keeps_budgets_and_hierarchy(spark):
    docs = table(spark, [(i, " ".join(words(5 + i % 40, i))) for i in range(400)]).withColumn("mixed", F.lit(0))
    rows = mixing.decide(docs).select("doc_id", "mix.*").collect()
    total = sum(r["n_tokens"] for r in rows)
    leaves = {}
    for r in rows:
        leaf = leaves.setdefault((r["domain"], r["language"], r["origin"]), [0, 0, r["part"]])
        leaf[0] += r["n_tokens"]
        leaf[1] += r["n_tokens"] * r["copies"]
    for tokens, taken, part in leaves.values():
        assert taken <= part <= 2 * tokens and part - taken < 50
    assert total - sum(part for _, _, part in leaves.values()) <= len(leaves)
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("domain0", "en", "a", 10), ("domain0", "en", "b", 1000), ("domain1", "en", "c", 1000)],
        "domain string, language string, origin string, tokens long",
    )
    rows = mixing.leaf_budgets(leaves, 400, 1, {}, {}).collect()
    assert {r["origin"]: r["part"] for r in rows} == {"a": 10, "b": 190, "c": 200}


def test_mixing_awkward_rows(spark, awkward):
    docs = awkward.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert mixing.decide(docs).count() == docs.count()
    assert mixing.mixture(awkward.limit(0)).count() == 0


# --- licenses, urls, fingerprints, search ------------------------------------


def test_license_scan_awkward_rows(spark, awkward):
    rows = {r["doc_id"]: r for r in licenses.scan(awkward).collect()}
    assert rows[9]["n_base"] == 2 and (rows[9]["first_word"], rows[9]["last_word"]) == (0, 4)
    assert rows[9]["base_labels"] == "gpl,mit" and rows[4]["n_words"] == 0 and rows[4]["labels"] == ""
    assert licenses.scan(awkward.limit(0)).count() == 0
    line = table(spark, [(1, "pad " * 50 + "Licensed under CC BY-NC 4.0. " + "pad " * 9)])
    assert licenses.scan(line).first()["labels"] == "cc"


def test_url_cascade_is_exact(spark):
    keys = spark.range(3000).select(
        F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed")
    )
    levels = url_filter.cascade(keys)
    wrong = keys.where(url_filter.member(F.col("key"), levels) != F.col("listed"))
    assert len(levels) > 1 and wrong.count() == 0
    assert url_filter.cascade(keys, max_bits=10) is None
    pages = spark.createDataFrame(
        [(1, None), (2, "nothing"), (3, "http://A.NET/es/x"), (4, "http://a.net/en/"), (5, "x://www.Example.com/en/a?b"),
         (6, "x://b.example.com/en/"), (7, "x://com"), (8, ""), (8, "")], "page_id long, url string",
    ).withColumn("host", F.lit("clash"))
    for bits in (url_filter.MAX_BITS, 1):
        got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, max_bits=bits).collect())
        assert got == [
            (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.net", "/es/x", "net/es/", "block"),
            (4, "a.net", "/en/", None, "block"), (5, "www.example.com", "/en/a", "www.example.com/en/", "allow"),
            (6, "b.example.com", "/en/", "example.com/en/", "block"), (7, "com", "", None, "allow"),
            (8, "", "", None, "allow"), (8, "", "", None, "allow"),
        ]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_fingerprints_awkward_rows(spark, awkward):
    rows = fingerprint.fingerprints(awkward).collect()
    texts = sorted(((-math.inf if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in awkward.collect()))
    want = []
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1]):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        want.append((str(None if i == -math.inf else i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.fingerprints(awkward.limit(0)).count() == 0


def test_topk_awkward_vectors(spark):
    draw = random.Random(9)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(8)]) for i in range(500)]
    rows += [(500 + i, [0.5] * 8) for i in range(300)]  # many ties
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [1.0]), (905, [])]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    usable = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = {}
    for r in topk.search(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (i for i in usable if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert topk.search(few, few.where("vec_id = 0")).count() == 2


def test_pipeline_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    from cairnlens.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == columns and docs.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == {
        r["doc_id"] for r in docs.select("doc_id").distinct().collect()
    }
