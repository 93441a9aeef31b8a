"""Faults of earlier rounds stay mended: recall, clashing names, repeated ids, long texts."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnlens.llm import fingerprint, grammar_store, language_model, mixing, near_dedup, packing, passages, periodic_runs, topk, toxicity

NAMES = ["end", "part", "epochs", "beyond", "mix", "figures", "row", "rest", "digest", "node", "class", "doc id", "_kept_id"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def words(n, draw):
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(n)]


def changed(text, mode, draw):
    """A fifth of the words are other ones, evenly or at random places."""
    out, k = list(text), len(text) // 5
    places = [5 * i + 2 for i in range(k)] if mode == "even" else draw.sample(range(len(text)), k)
    for i in places:
        out[i] = "x" + words(1, draw)[0]
    return out


@pytest.mark.parametrize("mode", ["even", "random"])
def test_near_copies_at_the_limit_are_found(spark, mode):
    draw, rows = random.Random(11), []
    lengths = [8, 12, 16, 20, 30, 50, 100, 300, 1000]
    for i, n in enumerate(lengths * 20):
        text = words(n, draw)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(changed(text, mode, draw)))]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(found[i] == found[i + 1] for i in range(0, len(rows), 2))
    wrong = sum(found[i] != i for i in range(0, len(rows), 2))
    assert hits >= 0.9 * len(rows) / 2 and not wrong


def test_texts_that_share_a_passage_are_rarely_aligned():
    draw = random.Random(12)
    passage = words(45, draw)
    with np.errstate(over="ignore"):
        keys = []
        for _ in range(300):
            text = words(240, draw)
            at = draw.randrange(240)
            joined = " ".join(text[:at] + passage + text[at:]).encode()
            keys.append(set(near_dedup.order_min_hashes(near_dedup.word_hashes(joined)[0]).tolist()))
    meeting = sum(bool(keys[i] & keys[j]) for i in range(300) for j in range(i))
    assert meeting < 0.06 * 300 * 299 / 2


WORKER_FUNCTIONS = """
from pyspark import cloudpickle
import cairnlens.llm.{module} as m
print(cloudpickle.dumps({expression}).hex())
"""


@pytest.mark.parametrize("module, expression", [
    ("near_dedup", "m._sketched(0.8)"), ("near_dedup", "m._verified(0.8)"), ("near_dedup", "m._word_numbers"),
    ("passages", "m._windows(3, 46)"), ("passages", "m._compared(50, 0.8)"), ("passages", "m._context_keys(50, 46)"),
    ("passages", "m._cut"), ("packing", "m._pieces(1024, False, None)"), ("packing", "m._packed(1024)"),
    ("grammar_store", "m._shards(None, 1000)"), ("grammar_store", "m._read"), ("periodic_runs", "m._scanned(12)"),
    ("conversation_repair", "m._plans"), ("conversation_repair", "m._streamed(True)"), ("language_model", "m._counted"),
    ("language_model", "m._mean"), ("topk", "m._extremes([], [])"),
])
def test_worker_functions_load_without_the_package(module, expression, tmp_path):
    """As on an executor, which has no copy of the package."""
    import os

    code = WORKER_FUNCTIONS.format(module=module, expression=expression)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    data = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.strip()
    load = f"import pickle; f = pickle.loads(bytes.fromhex('{data}')); import sys; assert not any('cairnlens' in m for m in sys.modules)"
    if len(load) > 100_000:
        load = load[:0]
    done = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_stages_take_columns_of_any_name(spark):
    draw = random.Random(13)
    base = words(120, draw)
    rows = [(i, " ".join(words(60, draw)), "en", f"s{i % 3}", 1) for i in range(20)]
    rows += [(20, " ".join(base), "en", "s", 1), (21, " ".join(base), "en", "s", 1), (None, None, None, None, None), (22, "", "", "", 0)]
    docs = clashing(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    kept = toxicity.accepted(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and kept.where("doc_id = 20").count() == 1
    single = near_dedup.without_near_duplicates(docs)
    assert single.columns == docs.columns and single.where("doc_id in (20, 21)").count() == 1
    assert single.where("doc_id = 20").select("`doc id`", "mix", "end").first() == (11, 4, 0)
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and mixed.where("doc_id = 20").first()["beyond"] == 3
    assert mixing.mixture(docs.limit(0)).count() == 0 and toxicity.accepted(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_mixture_takes_what_a_plain_recomputation_takes(spark):
    """Shares by hand on the driver; prefixes in the order of MD5 of seed, epoch and id."""
    import hashlib
    import zlib
    from fractions import Fraction

    draw = random.Random(14)
    rows = [(i, " ".join(words(draw.randint(0, 40), draw)), draw.choice(["en", "de", "xx"]), f"s{draw.randint(0, 9)}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tree = {}
    for i, text, lang, source, _ in rows:
        leaf = (f"domain{zlib.crc32(source.encode()) % 4}", lang, source)
        tree.setdefault(leaf, []).append((i, len(text.split())))
    tokens = {leaf: sum(n for _, n in own) for leaf, own in tree.items()}

    def shared(children, budget):  # name -> (weight, room)
        out, left, open_ = {}, budget, dict(children)
        for name, (w, room) in sorted(children.items(), key=lambda c: (Fraction(c[1][1], c[1][0]), c[0])):
            total = sum(w for w, _ in open_.values())
            if room * total <= w * left:
                out[name], left = room, left - room
                del open_[name]
            else:
                return out | {name: w * left // total for name, (w, _) in open_.items()}
        return out

    room = lambda *prefix: sum(2 * t for leaf, t in tokens.items() if leaf[: len(prefix)] == prefix)
    names = lambda *prefix: {leaf[len(prefix)] for leaf in tokens if leaf[: len(prefix)] == prefix}
    want, total = {}, sum(tokens.values())
    domains = shared({d: (mixing.DOMAIN_WEIGHTS[d], room(d)) for d in names()}, total)
    for d, budget in domains.items():
        languages = shared({x: (mixing.LANGUAGE_WEIGHTS.get(x, 1), room(d, x)) for x in names(d)}, budget)
        for x, more in languages.items():
            for leaf_name, part in shared({s: (1, room(d, x, s)) for s in names(d, x)}, more).items():
                own, size = tree[d, x, leaf_name], tokens[d, x, leaf_name]
                epochs, rest = divmod(part, size) if size else (1, 0)
                place = lambda i: int(hashlib.md5(f"{mixing.SEED}|{epochs}|{i}".encode()).hexdigest()[:10], 16)
                used, open_ = 0, rest > 0
                for i, n in sorted(own, key=lambda r: (place(r[0]), r[0], r[1])):
                    used += n
                    open_ = open_ and used <= rest
                    want[i] = epochs + open_
    got = {r["doc_id"]: r["copies"] for r in mixing.decide(docs).select("doc_id", "mix.copies").collect()}
    assert got == want


def test_queries_of_one_id_have_rankings_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.5]), (3, [0.25, 0.25])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.search(vectors, vectors.where("vec_id = 0"), 2)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    assert got == sorted([(1, 1, 512 * 1024), (2, 3, 256 * 1024), (1, 2, 512 * 1024), (2, 3, 256 * 1024)])


def test_very_long_runs_of_blanks_are_packed(spark):
    text = "a" + " " * 1_000_000 + "b" + "\n" * 300_000
    rows = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert sum(r["length"] for r in rows) == len(whole) + 1


def test_lanes_hold_no_more_than_their_tokens():
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, 9, n).astype(np.int32) for n in [5000, 1, 3, 2, 40] + [4] * 300]
    held = language_model.lanes(texts, 8)
    laid = language_model.Lanes(texts, held, 7)
    assert sum(len(ids) for _, _, ids, _ in laid.lanes) == sum(map(len, texts))
    seen = {i: [] for i in range(len(texts))}
    for at in range(0, laid.steps, 64):
        previous, keep, targets, owner = laid.window(at, at + 64)
        for column in range(owner.shape[1]):
            for step in range(len(owner)):
                i = owner[step, column]
                if i >= 0:
                    assert (keep[step, column] == 0) == (not seen[i])
                    assert previous[step, column] == (seen[i][-1] if seen[i] else 7)
                    seen[i].append(int(targets[step, column]))
    assert all(seen[i] == t.tolist() for i, t in enumerate(texts))


def test_gradients_of_all_weights_by_differences(spark):
    """Recurrent weights included, over a window in which a text starts anew."""
    counts = spark.createDataFrame([(bytearray(w.encode()), c) for w, c in (("", 9), ("a", 8), ("b", 5), ("c", 3), ("d", 1))], "word binary, c long")
    vocab = language_model.vocabulary(counts, 5, 2)
    draw = np.random.default_rng(5)
    steps, count, n = 7, 3, 4
    network = language_model.Network(vocab, hidden=n)
    weights = [w.astype(np.float64) + 0.3 * draw.standard_normal(w.shape) for w in network.weights()]
    previous, targets = draw.integers(0, len(vocab.words), (2, steps, count))
    keep = np.ones((steps, count))
    keep[3, 1] = 0

    def loss(values):
        h, total = np.zeros((count, n)), 0.0
        own = language_model.Network(vocab, [v.copy() for v in values], hidden=n)
        for t in range(steps):
            a = own.inputs[previous[t]] + (h * keep[t][:, None]) @ own.recurrent
            z, c = 1 / (1 + np.exp(-a[:, :n])), np.tanh(a[:, n:])
            h = z * (h * keep[t][:, None]) + (1 - z) * c
            total -= own.log_likelihood(h.copy(), targets[t]).sum()
        return total

    own = language_model.Network(vocab, [w.astype(np.float32) for w in weights], hidden=n)
    trace, grads = [], {}
    states = own.states(previous, keep.astype(np.float32), np.zeros((count, n), np.float32), trace)
    own.log_likelihood(states.reshape(-1, n).copy(), targets.reshape(-1), grads)
    back = language_model.backward(own, grads["states"].reshape(states.shape), trace, keep)
    exact = {"inputs": np.zeros_like(weights[0]), "recurrent": back[1]}
    np.add.at(exact["inputs"], previous.ravel(), back[0].reshape(-1, 2 * n))
    for name, at in (("inputs", 0), ("recurrent", 1)):
        for place in [tuple(draw.integers(0, s) for s in weights[at].shape) for _ in range(12)]:
            high, low = [w.copy() for w in weights], [w.copy() for w in weights]
            high[at][place] += 1e-5
            low[at][place] -= 1e-5
            assert abs((loss(high) - loss(low)) / 2e-5 - exact[name][place]) < 2e-3, (name, place)


def test_windows_of_one_repeated_word_take_linear_time():
    low, centre, high = passages.compact_windows(np.zeros(200_000, np.uint64))
    assert len(centre) == 200_000 - passages.LEAST + 1 and high == [199_999] * len(high) and low == centre
    assert periodic_runs.LEAST == 12 and grammar_store.END == 2


def test_merged_sketches_are_those_of_all_shingles(spark):
    import hashlib

    draw = random.Random(15)
    texts = [" ".join(words(draw.choice([0, 1, 3, 5, 6, 7, 9, 40]), draw)) for _ in range(120)]

    def shingles(text):
        w = text.split()
        return {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(len(w) - 4, 1))} if w else set()

    def plain(hashes):
        return sorted(h for h in hashes if h < fingerprint.LIMIT) or sorted(hashes)[:1]

    df = spark.createDataFrame([(i % 37 if i % 5 else None, t) for i, t in enumerate(texts)], "g long, text string")
    sketched = df.select("g", fingerprint.sketch(F.col("text")).alias("sketch"))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(i % 37 if i % 5 else None, set()).update(shingles(t))
    want = {g: plain(h) for g, h in groups.items()}
    assert any(len(s) == 1 and s[0] >= fingerprint.LIMIT for s in want.values()) and any(len(s) > 1 for s in want.values())
    assert {r["g"]: r["sketch"] for r in fingerprint.merge_sketches(sketched, ["g"]).collect()} == want
    listed = sketched.groupBy("g").agg(fingerprint.merged(F.collect_list("sketch")).alias("sketch"))
    assert {r["g"]: r["sketch"] for r in listed.collect()} == want


def test_word_bits_refuse_no_similar_pair(spark):
    draw = random.Random(16)
    rows, want = [], []
    for i in range(400):
        n = draw.choice([1, 4, 9, 30, 120, 700])
        a = words(n, draw)
        b = changed(a, "random", draw) if i % 2 else a[: n // 2] + words(n - n // 2, draw)
        with np.errstate(over="ignore"):
            x, y = (near_dedup.word_hashes(" ".join(t).encode())[0] for t in (a, b))
        rows.append((i, near_dedup.word_bits(x).tolist(), near_dedup.word_bits(y).tolist(), len(x), len(y)))
        want.append(bool(near_dedup.similar([(x >> np.uint64(32), y >> np.uint64(32))])[0]))
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>, n int, m int")
    allowed = {r[0]: r[1] for r in df.select("i", near_dedup._words_allow("a", "b", "n", "m", 0.8)).collect()}
    assert all(allowed[i] for i in range(400) if want[i])
    refused = [i for i in range(0, 400, 2) if rows[i][3] in (30, 120)]
    assert sum(not allowed[i] for i in refused) > 0.9 * len(refused)


def test_marks_refuse_long_texts_of_like_words_and_no_similar_pair(spark):
    """Copies of one long text with an eighth of the words replaced: a bit map allows each pair."""
    draw = np.random.default_rng(5)
    base, texts = draw.integers(0, 1 << 32, 740), []
    for _ in range(12):
        text = base.copy()
        text[draw.choice(740, 92, replace=False)] = draw.integers(0, 1 << 32, 92)
        texts.append(text.astype("<u4"))
    texts += [np.repeat(texts[0][:70], 10), np.tile(texts[0][:70], 10), texts[0][60:], np.zeros(740, "<u4"), texts[0][:0]]
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array([t.tobytes() for t in texts], pa.binary())], ["node", "words"])
    marked = pa.Table.from_batches(near_dedup._word_marks([rows])).to_pylist()
    one = spark.createDataFrame(
        [(r["node"], r["bits"], r["marks"], len(texts[r["node"]])) for r in marked],
        "node long, bits array<long>, marks array<int>, n int")
    other = one.toDF("other", "other_bits", "other_marks", "m")
    tests = (near_dedup._words_allow("bits", "other_bits", "n", "m", 0.8), near_dedup._marks_allow("marks", "other_marks", "n", "m", 0.8))
    found = one.crossJoin(other).where("node < other").select("node", "other", tests[0].alias("a"), tests[1].alias("b")).collect()
    similar = near_dedup.similar([(texts[r["node"]], texts[r["other"]]) for r in found])
    assert all(r["a"] and r["b"] for r, same in zip(found, similar) if same) and similar.sum() >= 1
    copies = [r for r in found if r["other"] < 12]
    assert all(r["a"] for r in copies) and sum(r["b"] for r in copies) <= 0.05 * len(copies)
