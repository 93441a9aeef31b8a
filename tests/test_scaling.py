"""Steps that move, write or hold less for the same rows."""

import glob
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlens.functions import chunks, keyed, text
from cairnlens.llm import passages
from cairnlens.operators import nested, ranges, retention, rules, runs
from cairnlens.plans import catalogue
from cairnlens.sources import sinks


def test_reports_are_stored_packed(spark, folder, tmp_path, monkeypatch):
    from cairnlens.plans import reports

    monkeypatch.setattr(reports, "shared_folder", lambda spark: str(tmp_path / "r"))
    assert catalogue.run("scan_reports", spark, folder).first()["report_count"] > 0
    files = glob.glob(f"{tmp_path}/r/part-*")
    assert files and all(f.endswith(".gz") for f in files)


def test_snapshots_are_stored_packed(spark, tmp_path):
    rows = [(t, "s", i, f'{{"id":"{t}-{i}"}}') for t in (1, None) for i in range(7)]
    records = spark.createDataFrame(rows, "task_id long, section string, position long, record string")
    sinks.write_snapshot(sinks.snapshot_documents(records, 3), str(tmp_path / "s"))
    files = glob.glob(f"{tmp_path}/s/section=s/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    assert sinks.stored_snapshot(spark, str(tmp_path / "s")).count() == 6


def test_rows_are_numbered_without_a_window_over_them(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.choice([None, 1, 1, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    found = keyed.numbered(df, "k", ["v"], "n", str(tmp_path / "n"))
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(k, v): sum(a == k and b < v for a, b in rows) for k, v in rows}
    assert {(r["k"], r["v"]): r["n"] for r in found.collect()} == want


def test_small_files_are_spread_and_parts_stay_small(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id", "repeat('x', 200) text").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert keyed.spread(df).rdd.getNumPartitions() == cores
    monkeypatch.setattr(keyed, "SPLIT_BYTES", 256)
    assert keyed.spread(df).rdd.getNumPartitions() > 2 * cores
    files = df.select(F.col("id").alias("file_id"), F.lit("c").alias("language"), F.lit("p").alias("logical_path"), "text")
    plan = rules.source_rule_scan(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def entries(spark, draw, n):
    rows = []
    for i in range(n):
        task = draw.choice([None, 1, 1, 1, 1, 2, 3])
        rows.append((task, draw.randint(1, 3), i * 3, f"e{i}", draw.randint(0, 900), draw.randint(1, 8), 400, 20))
    return spark.createDataFrame(
        rows, "task_id long, container_id long, ordinal long, entry_key string, expanded_bytes long, depth int,"
        " root_size_bytes long, container_size_bytes long")


def test_large_files_are_not_shuffled_to_spread_them(spark, tmp_path):
    spark.range(4000).selectExpr("id", "uuid() text").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    shuffled = lambda: "RepartitionByExpression" in keyed.spread(df)._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled()
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        assert not shuffled() and keyed.spread(df).count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)


def test_budgets_agree_whether_tasks_are_cut_or_dealt_whole(spark):
    df = entries(spark, random.Random(4), 300)
    small, large = chunks.parted(df, "task_id", 60)
    assert {r[0] for r in large.select("task_id").distinct().collect()} == {1}
    assert small.count() + large.count() == 300
    found = [sorted(map(str, ranges.extraction_budget(df, 9000, 50, 40, 6, span=s).collect())) for s in (1, 60, 1 << 20)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 300


@pytest.mark.parametrize("listed", [0, 1, 10_000])
def test_hits_meet_functions_of_listed_and_common_levels(spark, monkeypatch, listed):
    monkeypatch.setattr(runs, "LISTED_PROJECTS", listed)
    draw = random.Random(5)
    functions = [(draw.randint(1, 3), i, a, a + draw.choice([3, 40, 700, 90_000])) for i in range(60) for a in [draw.randint(1, 2000)]]
    functions += [(4, 60, 10, 20)]
    hits = [(i, draw.randint(1, 5), a, a + 1) for i in range(200) for a in [draw.randint(1, 3000)]]
    got = runs.finding_in_function(
        spark.createDataFrame(hits, "hit_id long, project_id long, start_line long, end_line long"),
        spark.createDataFrame(functions, "project_id long, result_id long, start_line long, end_line long"), 64)
    want = [(h[0], f[1]) for h in hits for f in functions if h[1] == f[0] and h[2] >= f[2] and h[3] <= f[3]]
    assert sorted((r["hit_id"], r["result_id"]) for r in got.collect()) == sorted(want) and want


def test_entries_meet_derived_uploads_before_other_tables(spark):
    shape = "logical_path string, detected_category string, detected_format string, size_bytes long, sha256 string, blob_id long"
    rows = [("a", "binary", "elf64", 1, "s", 3), ("b", "binary", "elf64", 1, "s", 3), ("a", "binary", "elf64", 1, "s", None)]
    derived = spark.createDataFrame([("a", "binary", "elf64", 1, "s", 3)] * 2 + [("a", "binary", "elf64", 1, "s", None)], shape).toDF(
        "source_entry_path", "input_category", "detected_format", "declared_size_bytes", "actual_sha256", "blob_id")
    kept = retention._matching_entries(spark.createDataFrame(rows, shape), derived).collect()
    assert [tuple(r) for r in kept] == rows[:1]


def test_cheap_tests_change_no_text(spark):
    values = ["", " ", "a", "a b", "a  b", " a\tb ", "a\x01b", "é x", "x" * 40, "https://a.example/x?y#z", "HTTP://a.example", "http://a b",
              "https://u:p@h/", "http://[::1]:80/x", "http://a.example/%zz", "http://a.example/%41", "https://a.example:80", "http://" + "a" * 5000]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    trimmed = text.trim_space("v")
    one_line = F.regexp_replace(trimmed, f"[{text.SPACE}]+", " ")
    slow = F.when(~F.rlike(trimmed, F.lit(text.CONTROL_BUT_BREAKS)), text.cut_bytes(one_line, 20))
    usable = (F.octet_length(trimmed) <= 4096) & F.rlike(trimmed, F.lit(text.HTTP_URL)) & ~F.rlike(trimmed, F.lit(text.BAD_ESCAPE))
    for r in df.select("v", slow.alias("a"), text.display_text("v", 20).alias("b"), usable.alias("c"), text.http_url("v", 4096).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == (r["d"] != ""), r
    assert text.PLAIN_URL in df.select(text.http_url("v"))._jdf.queryExecution().optimizedPlan().toString()


def test_joined_reference_lists_give_what_single_addresses_give(spark):
    draw = random.Random(8)
    parts = ["http://a.example", "https://a.example/x?y=%zz#z", "http://a.example/%41", "http://a.example/%4", "1", " ", "\n", "é",
             "HTTP://A.example/B", "hTTps://b", "http://u:p@h/", "http://[::1]:80/x", "http://[x]", "ftp://c", "http://a b", "", "\x01",
             "http://a:80", "http://a:8x", "http://" + "a" * 2041, "http://" + "a" * 2042, "http:///x", "https://", " http://d ", "\u00a0http://e", "http://q?%"]
    one = lambda: draw.choice([None, draw.choice(parts), draw.choice(parts) + draw.choice(["", "", draw.choice(parts)])])
    rows = [(one(), draw.choice([None, [one() for _ in range(draw.randint(0, 4))]]), one()) for _ in range(1500)] + [("https://c", [p], None) for p in parts]
    df = spark.createDataFrame(rows, "p string, l array<string>, s string")
    single = F.array_distinct(text._usable_urls("p", "l", "s"))
    found = df.select("*", single.alias("a"), text.merged_references("p", "l", "s").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in found) and any(len(r["b"]) > 2 for r in found)
    assert "regexp_extract_all" in df.select(text.merged_references("p", "l", "s"))._jdf.queryExecution().optimizedPlan().toString()


def test_trimmed_columns_are_trimmed_texts(spark):
    ends = ["", " ", "\t", "\n", "\x01", "\x7f", "\x85", "\xa0", "\u1680", "\u2003", "\u3000", "é", "~", "!", "x"]
    df = spark.createDataFrame([(a + m + b,) for a in ends for b in ends for m in ("", "a", " b ")] + [(None,)], "v string")
    assert all(r["a"] == r["b"] for r in df.select(text.trim_space("v").alias("a"), text.trim_column("v").alias("b")).collect())


def test_reports_tested_together_get_the_reasons_of_their_parts(spark):
    draw = random.Random(9)
    odd = [None, "", " ", "x", " x ", "é", "x" * 129, "x" * 600, "a\nb", "\x01", "\u3000", "LOW", "low ", "LOW\nHIGH", "SEVERE"]
    pick = lambda usual: draw.choice(odd) if draw.random() < 0.04 else usual
    def vulnerability():
        if draw.random() < 0.02:
            return None
        v = {"VulnerabilityID": pick(" CVE "), "PkgName": pick("p"), "InstalledVersion": pick("1"), "Severity": pick("high"), "FixedVersion": pick(""),
             "PkgPath": pick(None), "Title": pick(" a\n"), "DataSource": draw.choice([None, {"ID": pick("d"), "Name": pick(None)}])}
        return {k: x for k, x in v.items() if x is not None}
    def result():
        r = {"Target": pick("t"), "Class": pick("c"), "Type": pick("d"), "Secrets": draw.choice([None, [], [], pick("x" if draw.random() < 0.1 else ""), {}]),
             "Vulnerabilities": draw.choice([None, [], *([[vulnerability() for _ in range(draw.randint(1, 3))]] * 4)])}
        return draw.choice([r, {k: x for k, x in r.items() if x is not None}]) if draw.random() > 0.02 else None
    bodies = [json.dumps({"SchemaVersion": 2, "ArtifactName": "a", "ArtifactType": "i", "Results": draw.choice([None, [], *([[result() for _ in range(draw.randint(1, 3))]] * 6)])})
              for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(bodies)), "report_id INT, document STRING")
    each = F.get(F.array_compact(F.transform("report.Results", lambda r: nested._result_reason(r))), F.lit(0))
    rows = nested.parse_reports(df).select("report_id", each.alias("reason"), nested._surely_fine(F.col("report.Results")).alias("fine")).collect()
    assert not [r for r in rows if r["fine"] and r["reason"]]
    fine = [r for r in rows if r["reason"] is None]
    assert 2 * sum(bool(r["fine"]) for r in fine) > len(fine) and len({r["reason"] for r in rows}) > 8
    assert {r["report_id"]: r["reason"] for r in nested.checked_reports(df).collect()} == {r["report_id"]: r["reason"] for r in rows}


def plain_path(same, similarity):
    """One pair, a word and a column at a time."""
    n, width = same.shape
    up, down = round((1 - similarity) * 1000), round(similarity * 1000)
    table = [[0] * width]
    for i in range(n):
        row = []
        for k in range(width):
            best = table[i][k] + (up if same[i][k] else -down)
            if k + 1 < width:
                best = max(best, table[i][k + 1] - down)
            row.append(max(best, row[-1] - down) if k else best)
        table.append(row)
    i, k, path = n, max(range(width), key=lambda k: (table[n][k], -k)), []
    while i:
        if table[i][k] == table[i - 1][k] + (up if same[i - 1][k] else -down):
            i -= 1
            path.append((bool(same[i][k]), i, k))
        elif k + 1 < width and table[i][k] == table[i - 1][k + 1] - down:
            i -= 1
            path.append((False, i, k))
            k += 1
        else:
            path.append((False, i, k))
            k -= 1
    return path[::-1]


def test_pairs_are_aligned_together_as_one_by_one():
    draw = np.random.default_rng(6)
    pairs = []
    for i in range(60):
        a = draw.integers(0, 40, int(draw.integers(1, 160))).astype(np.uint32)
        b = np.delete(a, draw.integers(0, len(a), len(a) // 12))
        b = np.where(draw.random(len(b)) < 0.1, 99, b).astype(np.uint32)
        pairs.append((a, b, int(draw.integers(-2, 3)), int(draw.integers(1, 9)) if i % 7 == 0 else None))
    tables = [passages._equal_words(a, b, shift, apart, 10) for a, b, shift, apart in pairs if len(b)]
    for table, (flags, own, column) in zip(tables, passages._best_paths(tables, 0.8)):
        path = plain_path(table, 0.8)
        assert [(f, i) for f, i, _ in path] == list(zip(flags.tolist(), own.tolist()))
        assert [k for f, _, k in path if f] == column[flags].tolist()
    together = passages.stretches_of_pairs(pairs)
    assert any(together) and together == [passages.matching_stretches(a, b, s, apart=x) for a, b, s, x in pairs]
