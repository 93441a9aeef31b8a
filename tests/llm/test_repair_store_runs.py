"""Conversation repair, token-id files and runs against brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlens.llm import conversation_repair as repair
from cairnlens.llm import grammar_store as store
from cairnlens.llm import periodic_runs, queries
from compare import connect, differences

NAMES = ["key", "pos", "kind", "number", "code", "first", "again", "edits", "initial", "runs", "words", "part", "tie", "h", "g"]


def clashing(df):
    return df.select("*", *[F.lit(1).alias(n) for n in NAMES])


def check_view(con, name, rows, schema):
    """A DuckDB view of given rows."""
    con.execute(f"CREATE OR REPLACE TEMP TABLE {name} ({schema})")
    if rows:
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return con


# --- conversation repair -----------------------------------------------------


def enumerated(rows, limit):
    """Cheapest audit by trying all edits."""
    best = (limit + 1, "")

    def go(i, out, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", "".join(out)):
                best = min(best, (cost, audit))
        else:
            initial, fault = rows[i]
            go(i + 1, out, cost + 3, audit + "D")
            if fault not in "bd":
                late = fault == "t"
                go(i + 1, [*out, initial], cost + late, audit + "K")
                for given in "ua":
                    go(i + 1, [*out, given], cost + 2 + late, audit + "R")
        for given in "ua":
            go(i, [*out, given], cost + 2, audit + "I")

    go(0, [], 0, "")
    return best


def test_cheapest_audit_is_the_least_of_all():
    draw = random.Random(3)
    for _ in range(60):
        rows = [(draw.choice("suax"), draw.choice("bdt---")) for _ in range(draw.randrange(0, 4))]
        got = repair.cheapest("".join(a + b for a, b in rows))
        assert got == enumerated(rows, got[0]), rows


def table_scan(codes):
    """Least (cost, audit) by one pass over the rows, all states at a time."""
    now = {0: (0, "")}

    def inserts(now):
        for _ in range(4):
            for q, (cost, audit) in list(now.items()):
                for initial, _, t, more in repair.steps("", 0, q):
                    now[t] = min(now.get(t, (1 << 60, "")), (cost + more, audit + initial))
        return now

    for i in range(len(codes) // 2):
        after = {}
        for q, (cost, audit) in inserts(now).items():
            for initial, j, t, more in repair.steps(codes, i, q):
                if j > i:
                    after[t] = min(after.get(t, (1 << 60, "")), (cost + more, audit + initial))
        now = after
    now = inserts(now)
    return min(now[q] for q in repair.ACCEPTED if q in now)


def test_cheapest_agrees_with_a_plain_pass():
    draw = random.Random(8)
    for n in [*range(12)] * 40 + [200, 1000]:
        codes = "".join(draw.choice("suax" if n % 2 else "ua") + draw.choice("bdt----") for _ in range(n))
        assert repair.cheapest(codes) == table_scan(codes), codes


def test_a_long_conversation_takes_time_in_proportion():
    draw = random.Random(4)
    codes = "".join(draw.choice("ua") + draw.choice("t--") for _ in range(30000))
    cost, audit = repair.cheapest(codes)
    assert len(audit.replace("I", "")) == 30000 and cost > 0


CONVERSATIONS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes!"), (1, 4, "user", "no end"),
    (2, 0, "user", None), (2, None, None, "who."), (2, 3, "assistant", ""), (2, 3, "assistant", ""), (2, 3, "assistant", "so."),
    (None, 0, "user", "null id."), (None, 1, "", "no role."), (3, None, "user", "x."), (4, 5, "User", " \t\n"),
    (5, 1, "user", "same."), (5, 2, "user", "same."), (5, 3, "assistant", "… é"), (-7, -3, "assistant", "back.\n"), (-7, 4, "user", "a" * 70000),
] + [(6, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(300)] + [
    (100 + c, t, random.Random(c * 50 + t).choice(["user", "assistant", "system"]), f"{t % 3}.") for c in range(40) for t in range(6)
]


@pytest.mark.parametrize("rows", [CONVERSATIONS, [], [(9, None, None, None)]])
def test_audits_match_sql_on_awkward_rows(spark, con, folder, rows):
    own = check_view(connect(folder), "own", rows, "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR")
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sql = re.sub(r"FROM conversations\b", "FROM own", queries.ORACLE_SQL["op11_conversation_repair"])
    assert differences(repair.audited(df), own, sql) == ""


def test_repaired_rows_are_sound_conversations(spark):
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    found = {}
    for r in repair.repair(rows).orderBy("conv_id", "n").collect():
        found.setdefault(r["conv_id"], []).append(r)
    assert all(re.fullmatch(r"s?(ua)+", "".join(r["role"][:1] for r in part)) for part in found.values())
    assert [r["text"] for r in found[6]] == [f"turn {t}." for t in range(300)]
    assert {r["initial"] for r in found[6]} == {"K"}


# --- token ids in files ------------------------------------------------------


def test_words_encoded_apart_give_the_ids_of_the_whole_text():
    coder, draw = store.WordCoder(), random.Random(5)
    parts = list("abCDé ÉçİΣς.,;:!?'’…\"-<|> \t\n\x0b\x1c\x1f\x85\xa0́̇ı　漢字१२0123ßs🙂‍")
    parts += ["<|endoftext|>", "<|STARTOFTEXT|>", "don't", "it's.", "é.", "we'll've", "a" * 3000]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(0, 25)))
        want = coder.tool.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder(text.encode()), "<u2").tolist() == want, repr(text)


def test_shards_give_back_their_documents():
    draw = random.Random(6)
    for _ in range(200):
        base = draw.choice([3, 5, 300])
        docs = [np.array([draw.randrange(base) for _ in range(draw.randrange(0, 90))] + [2], np.uint16) for _ in range(draw.randrange(1, 6))]
        docs.append(np.array([1] * draw.randrange(1, 200) + [2], np.uint16))
        ids = [None, *range(len(docs) - 1)]
        shard = store.Shard(store.packed_shard(docs, ids, base))
        assert shard.doc_ids == ids
        assert [d.tolist() for d in shard.documents()] == [d.tolist() for d in docs]
        whole = np.concatenate(docs)
        for _ in range(10):
            i = draw.randrange(len(whole) + 1)
            j = draw.randrange(i, len(whole) + 1)
            assert shard.ids_between(i, j).tolist() == whole[i:j].tolist()


def test_frequent_pairs_become_rules():
    ids = np.array([1, 2, 3, 4] * 500 + [0], np.uint16)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    grammar, symbols, _ = store.repair_pairs(ids, last, 10)
    assert len(symbols) < 100 and grammar.lengths.max() >= 8
    assert grammar.expand(symbols).tolist() == ids.tolist()


DOCS = [(5, "Hello there. Hello there!"), (1, None), (2, ""), (2, "<|endoftext|> É"), (None, "no id"), (9, "long words " * 30000),
        (7, " \t\n"), (7, "x" * 5000), (7, " \t\n"), (-3, "it's we'll. 123 … “quoted”"), (None, None)]


@pytest.mark.parametrize("rows", [DOCS, []])
def test_files_hold_all_documents_in_order(spark, rows):
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    found = store.read_ids(spark, store.stored_folder(df)).collect()
    tool = store.WordCoder().tool
    want = sorted((d is not None, d or 0, tuple(tool.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in found)
    assert got == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_small_shards_and_the_query(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    store.write_ids(docs, str(tmp_path / "ids"), shard_ids=2000)
    small = {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in store.read_ids(spark, str(tmp_path / "ids")).collect()}
    assert spark.read.parquet(str(tmp_path / "ids")).count() > 20
    query = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op12_token_ids(spark, folder).collect()}
    assert query == small and len(query) == docs.count()


# --- runs --------------------------------------------------------------------


def all_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    draw = random.Random(1)
    for _ in range(1500):
        words = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randrange(0, 70))]
        if words and draw.random() < 0.5:
            p, a = draw.randrange(1, 8), draw.randrange(len(words))
            words = words[:a] + [words[min(a + (i - a) % p, len(words) - 1)] for i in range(a, len(words))]
        least = draw.choice([2, 4, 5, 12])
        assert periodic_runs.runs(np.array(words, np.int64), least) == all_runs(words, least), (words, least)


def test_runs_of_very_long_texts():
    assert periodic_runs.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic_runs.runs(np.tile(np.arange(7), 30_000)) == [(0, 210_000, 7)]


RUN_DOCS = [(1, None), (2, ""), (2, ""), (3, " \t\n"), (4, "ha " * 40), (5, "Ha ha " * 3 + "x " * 12 + "a b c d e f " * 2), (None, "no no " * 9),
            (6, "one\x0btwo\x0c" * 7), (7, "é ü " * 8), (-4, "a b " * 10)] + [
    (i, " ".join(random.Random(i).choice("ab") for _ in range(i % 60))) for i in range(10, 200)
] + [(i, " ".join(f"w{(j * i) % 91}" for j in range(150))) for i in range(300, 360)]


@pytest.mark.parametrize("rows", [RUN_DOCS, []])
def test_runs_match_sql_on_awkward_rows(spark, folder, rows):
    own = check_view(connect(folder), "own", rows, "doc_id BIGINT, text VARCHAR")
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.looped(docs)))
    sql = queries.RUNS_SQL.replace("FROM documents", "FROM own")
    assert differences(found, own, sql) == ""


def test_collapsed_text_keeps_one_period(spark):
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, "say " + "ha ho " * 8 + "end")], "doc_id long, text string")).first()
    assert row["collapsed"] == "say ha ho end" and [tuple(r) for r in row["runs"]] == [(1, 16, 2)]
    assert queries.periodic_runs.LEAST == 12 and hashlib.sha256(b"").hexdigest()
