"""Chunked windows, per-key limits and text functions against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairnlens.functions import chunks, keyed, text
from cairnlens.operators import metrics


@pytest.fixture(scope="module")
def numbered(spark):
    rng = random.Random(7)
    rows = []
    for key in range(5):
        order = 0
        for _ in range(2000 if key == 0 else 40):  # key 0 holds most rows
            order += rng.choice([1, 1, 2, 50])
            rows.append((key, order, rng.randint(1, 100)))
    return rows, spark.createDataFrame(rows, "k INT, o BIGINT, v BIGINT").repartition(7)


def _by_key(rows):
    out = {}
    for row in sorted(rows):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("span", [1, 7, 1000, 1 << 20])
def test_neighbours(numbered, span):
    rows, df = numbered
    lagged = {(r.k, r.o): r.p for r in chunks.lag_value(df, ["k"], "o", "v", "p", span).collect()}
    led = {(r.k, r.o): r.n for r in chunks.lead_value(df, ["k"], "o", "v", "n", span).collect()}
    for group in _by_key(rows).values():
        for i, (k, o, _) in enumerate(group):
            assert lagged[k, o] == (group[i - 1][2] if i else None)
            assert led[k, o] == (group[i + 1][2] if i + 1 < len(group) else None)
    assert len(lagged) == len(rows)


@pytest.mark.parametrize("span", [1, 13, 1 << 20])
def test_prefixes(numbered, span):
    rows, df = numbered
    sums = chunks.prefix_totals(df, ["k"], "o", {"s": F.col("v"), "n": F.lit(1)}, span=span)
    peaks = chunks.prefix_maxima(df, ["k"], "o", {"m": F.col("v")}, span=span)
    got = {(r.k, r.o): (r.s, r.n) for r in sums.collect()}
    top = {(r.k, r.o): r.m for r in peaks.collect()}
    for group in _by_key(rows).values():
        for i, (k, o, _) in enumerate(group):
            before = [v for _, _, v in group[:i]]
            assert got[k, o] == (sum(before), i)
            assert top[k, o] == (max(before) if before else None)


def test_ranked_and_first(numbered):
    rows, df = numbered
    kept = keyed.ranked_per_key(df, ["k"], [F.desc("v"), F.col("o")], 9).collect()
    first = {r.k: (r.o, r.v) for r in keyed.first_per_key(df, ["k"], [F.desc("v"), F.col("o")]).collect()}
    for k, group in _by_key(rows).items():
        expected = sorted(group, key=lambda r: (-r[2], r[1]))[:9]
        found = sorted((r for r in kept if r.k == k), key=lambda r: r["rank"])
        assert [(r.o, r.v) for r in found] == [(o, v) for _, o, v in expected]
        assert first[k] == (expected[0][1], expected[0][2])


def test_stage_intervals_do_not_depend_on_span(spark):
    rng = random.Random(3)
    rows = [
        (0 if rng.random() < 0.7 else i % 4, i, rng.choice(["validating", "SCANNING", None, "odd"]),
         1_704_067_200 + i * 60)
        for i in range(3000)
    ]
    events = spark.createDataFrame(rows, "task_id BIGINT, event_sequence BIGINT, stage STRING, s BIGINT")
    events = events.withColumn("created_at", F.timestamp_seconds("s"))
    results = [
        sorted(map(tuple, metrics.stage_intervals(events, "2024-01-05 00:00:00", span)
                   .select("task_id", "event_sequence", "stage", "completed_at").collect()))
        for span in (5, 1 << 20)
    ]
    assert results[0] == results[1] and results[0]


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x STRING").select(expression.alias("y")).first().y


@pytest.mark.parametrize("value", ["a" * 9, "é" * 9, "日本語" * 3, "a😀b😀c", "abc", "ab  ééé"])
def test_cut_bytes(spark, value):
    got = _one(spark, value, text.cut_bytes("x", 8))
    if len(value.encode()) <= 8:
        assert got == value
    else:
        cut = value.encode()[:5].decode(errors="ignore").strip()
        assert got == cut + "..."


@pytest.mark.parametrize("value,expected", [
    (" a\t b\n\nc ", "a b c"), ("a\x0bb", None), ("a\x00b", None), ("　x y ", "x y"),
    ("", ""), ("\x0b a", "a"),
])
def test_display_text(spark, value, expected):
    assert _one(spark, value, text.display_text("x", 100)) == expected


@pytest.mark.parametrize("value,expected", [
    ("HTTPS://h.example/a", "https://h.example/a"), ("http://h:80", "http://h:80"),
    ("http://h:8x/", ""), ("http://u@h/", ""), ("http://", ""), ("ftp://h/", ""),
    ("http://h/%zz", ""), ("http://h/%41?%zz", "http://h/%41?%zz"), ("http://h/a b", ""),
    (" http://[::1]/x ", "http://[::1]/x"), ("http://h/ ", "http://h/"),
    ("http://h/" + "a" * 2040, ""),
])
def test_http_url(spark, value, expected):
    assert _one(spark, value, text.http_url("x")) == expected


@pytest.mark.parametrize("value,expected", [
    ("/a/b", "a/b"), ("/", None), ("a", None), ("/a//b", None), ("/a/./b", None),
    ("/a/..", None), ("/a/", None), ("/a\x01", None), ("/..a/b.", "..a/b."), ("//a", None),
])
def test_relative_path(spark, value, expected):
    assert _one(spark, value, text.relative_path("x")) == expected


def test_targets_and_names(spark):
    df = spark.createDataFrame([("img", "img (debian 12)"), ("img", "img"), ("", "t"), ("img", "img2")], "a STRING, t STRING")
    assert [r.y for r in df.select(text.report_target("a", "t").alias("y")).collect()] == [
        "debian 12", "container image", "t", "img2"]
    assert _one(spark, "x (y) (z)", text.readable_target("x")) == "z"
    assert _one(spark, "p/oci-layout@sha256:1", text.readable_target("x")) == "container image"
    long = "p/" + "q" * 400
    name = _one(spark, long, text.archive_task_name(F.lit("n" * 100), "x"))
    assert len(name) == 255 and name.startswith("n" * 77 + "... :: ...") and name.endswith("q")


@pytest.mark.parametrize("value,java,native", [
    ("", 0, 0), ("a", 1, 1), ("a\n", 1, 1), ("a\r\nb", 2, 2), ("\r\r\n\n", 3, 2), ("\n", 1, 1),
    ("a\rb", 2, 1),
])
def test_lines(spark, value, java, native):
    assert _one(spark, value, text.line_count("x")) == java
    assert _one(spark, value, text.line_span("x")) == native


def test_keys(spark):
    expected = hashlib.sha256(b"2:\xc3\xa91:b").hexdigest()
    assert _one(spark, "é", text.stable_key("p", "x", F.lit("b"))) == f"p:{expected}"


def test_progress_and_ratio(spark):
    points, unknown = text.weighted_progress(F.lit(" extracting"), F.lit(2500))
    assert spark.range(1).select(points.alias("p"), unknown.alias("u")).first() == (2500, False)
    points, unknown = text.weighted_progress(F.lit("REPORTING"), F.lit(None).cast("int"))
    assert spark.range(1).select(points.alias("p"), unknown.alias("u")).first() == (9500, False)
    big = 9_000_000_000_000_000_000
    rows = spark.createDataFrame([(0, 0), (1, 0), (50, 1), (51, 1), (big, big // 50)], "u BIGINT, c BIGINT")
    assert [r.y for r in rows.select(text.ratio_exceeded("u", "c", 50).alias("y")).collect()] == [
        False, True, False, True, False]
