"""Reports, images, signatures, sinks and streams on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from cairnlens.operators import classify, images, nested, quality, runs
from cairnlens.session import shared_folder
from cairnlens.sources import documents, sinks


def _report(**changes):
    vulnerability = {
        "VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1", "Severity": "high",
    }
    vulnerability.update(changes.pop("v", {}))
    body = {
        "SchemaVersion": 2, "ArtifactName": "a", "ArtifactType": "image",
        "Results": [{"Target": "t", "Class": "c", "Type": "d", "Vulnerabilities": [vulnerability]}],
    }
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v is not None})


CASES = [
    (_report(), None), ("[1", "not_json"), (_report(Odd=1), "unknown_field"),
    (_report(ArtifactType=None), "missing_field"), (_report(Results=None), "missing_results"),
    (_report(Results=None, ArtifactType="vm"), None), (_report(SchemaVersion=3), "schema_version"),
    (_report(ArtifactName=" "), "artifact_name"),
    (_report(Results=[{"Secrets": [1]}]), "disabled_scanner"),
    (_report(Results=[{"Secrets": []}]), None),
    (_report(v={"Severity": "SEVERE"}), "severity"), (_report(v={"PkgName": " "}), "package_name"),
    (_report(v={"VulnerabilityID": "x" * 129}), "vulnerability_id"),
    (_report(v={"PkgPath": "x" * 2000}), None), (_report(v={"PkgPath": "x" * 2049}), "package_path"),
    (_report(v={"Title": "a\u0001"}), "title"), (_report(v={"Title": " a\n"}), None),
    (_report(v={"DataSource": {"Name": "\u0002"}}), "source_name"),
]


def test_report_reasons(spark):
    rows = [(i, body) for i, (body, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "report_id INT, document STRING")
    got = {r.report_id: r.reason for r in nested.checked_reports(df).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES)}
    kept = nested.explode_findings(nested.accepted_reports(df))
    assert {r.severity for r in kept.collect()} == {"HIGH"}


def test_scan_reports_keeps_broken_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(_report())
    (tmp_path / "b.json").write_text('{"SchemaVersion": 2,')
    rows = documents.scan_reports(spark, str(tmp_path)).collect()
    assert sorted(r._corrupt is None for r in rows) == [False, True]


EDGES = "archive_id STRING, parent STRING, child STRING, child_kind STRING, reference STRING"


def _roots(spark, *rows):
    return spark.createDataFrame(list(rows), "archive_id STRING, digest STRING")


def test_image_closure(spark):
    edges = [
        ("x", "root", "i1", "index", "r1"), ("x", "i1", "m1", "manifest", None),
        ("x", "i1", "root", "index", None), ("x", "root", "m2", "manifest", None),
    ]
    df, roots = spark.createDataFrame(edges, EDGES), _roots(spark, ("x", "root"))
    closure = images.image_index_closure(roots, df)
    assert {(r.digest, r.depth, r.deepest, r.behind_cycle) for r in closure.collect()} == {
        ("i1", 0, None, True), ("m2", 0, None, True), ("m1", 1, None, True), ("root", 1, None, True)}
    walk = images.image_walk(roots, df)
    assert {(r.digest, r.reference, r.depth) for r in walk.collect()} == {
        ("i1", "r1", 0), ("m2", None, 0), ("m1", "r1", 1), ("root", "r1", 1), ("m2", "r1", 2)}
    targets = {(r.digest, r.reference) for r in images.image_targets(walk).collect()}
    assert targets == {("m1", "r1"), ("m2", "m2"), ("m2", "r1")}
    chain = [("y", f"n{i}", f"n{i + 1}", "index", None) for i in range(14)]
    deep = images.image_index_closure(_roots(spark, ("y", "n0")), spark.createDataFrame(chain, EDGES))
    assert sorted(r.depth for r in deep.filter("too_deep").collect()) == [9, 10, 11, 12, 13]


def test_image_closure_of_diamonds(spark):
    """Diamonds in a chain: 2 ** 8 paths, one row a node."""
    edges, n = [], 8
    for i in range(n):
        for side in "ab":
            edges += [("d", f"n{i}", f"{side}{i}", "index", None), ("d", f"{side}{i}", f"n{i + 1}", "index", None)]
    edges += [("d", "n0", f"n{n}", "index", None), ("d", f"n{n}", "m", "manifest", None), ("e", "n0", "m", "manifest", None)]
    rows = images.image_index_closure(_roots(spark, ("d", "n0"), ("e", "none")), spark.createDataFrame(edges, EDGES)).collect()
    assert len(rows) == 3 * n + 1 and not any(r.behind_cycle for r in rows)
    found = {r.digest: (r.depth, r.deepest) for r in rows}
    assert found[f"n{n}"] == (0, 2 * n - 1) and found["m"] == (1, 2 * n)
    empty = images.image_index_closure(_roots(spark), spark.createDataFrame([], EDGES))
    assert empty.count() == 0


def test_manifest_check(spark):
    digest = "sha256:" + "a" * 64
    described = [  # digest, os, architecture, variant, reference_type, reference_digest
        ("plain", None, None, None, None, None), ("same", "linux", "arm64", "v8", None, None),
        ("other", "linux", "amd64", None, None, None), ("broken", None, None, None, None, None),
        ("seal", "unknown", "unknown", None, "attestation-manifest", digest),
        ("unsealed", "unknown", "unknown", None, "attestation-manifest", "sha256:1"),
        ("layered", "unknown", "unknown", None, "attestation-manifest", digest), ("elsewhere", None, None, None, None, None),
    ]
    descriptors = spark.createDataFrame(
        [("x", "gone" if d[0] == "elsewhere" else "root", *d) for d in described],
        "archive_id STRING, parent STRING, digest STRING, os STRING, architecture STRING, variant STRING,"
        " reference_type STRING, reference_digest STRING")
    manifests = spark.createDataFrame([(d[0], f"c-{d[0]}") for d in described], "digest STRING, config STRING")
    sealed = {"seal", "unsealed", "layered"}
    configs = spark.createDataFrame(
        [(f"c-{d[0]}", *(("unknown", "unknown", None) if d[0] in sealed else ("lin ux", "arm64", None) if d[0] == "broken"
                         else ("linux", "arm64", "v8"))) for d in described],
        "digest STRING, os STRING, architecture STRING, variant STRING")
    layers = spark.createDataFrame(
        [(d[0], 0, f"l-{d[0]}", "application/vnd.in-toto+json" if d[0] in sealed else "tar") for d in described]
        + [("layered", 1, "l2", "tar")], "manifest STRING, ordinal INT, digest STRING, media_type STRING")
    edges = spark.createDataFrame([("x", "root", d[0], "manifest", "r" if d[0] == "same" else None) for d in described[:-1]], EDGES)
    roots = _roots(spark, ("x", "root"))
    walk = images.image_walk(roots, edges)
    checked = images.manifest_check(roots, walk, descriptors, manifests, configs, layers)
    assert {r.digest: (r.role, r.violation) for r in checked.collect()} == {
        "plain": ("image", None), "same": ("image", None), "other": ("image", "platform_mismatch"),
        "broken": ("image", "platform_invalid"), "seal": ("attestation", None),
        "unsealed": ("attestation", "attestation_invalid"), "layered": ("attestation", "attestation_invalid")}
    targets = images.scan_targets(walk, checked).collect()
    assert {(r.digest, r.architecture, r.layer_count, r.reference_count) for r in targets} == {("plain", "arm64", 1, 1), ("same", "arm64", 1, 1)}
    members = images.image_members(walk, manifests, layers)
    assert {(r.kind, r.ordinal, r.digest) for r in members.filter("manifest = 'layered'").collect()} == {
        ("config", None, "c-layered"), ("layer", 0, "l-layered"), ("layer", 1, "l2")}


HEADERS = [
    ("7F454C4602", "elf64"), ("504B0304", "zip"), ("CAFEBABE00000034", "java-class"),
    ("CFFAEDFE", "macho-thin"), ("6465780A30333500", "dex"), ("6F0D0D0A", "pyc"),
    ("1F8B08", "gzip"), ("425A6839314159265359", "bzip2"), ("425A68", "unknown"),
    ("00" * 257 + "757374617200", "tar"), ("00" * 510 + "55AA4546492050415254", "gpt-img"),
    ("00" * 510 + "55AA", "mbr-img"), ("00" * 32769 + "4344303031", "iso9660"), ("", "unknown"),
]


def test_signatures(spark):
    rows = [(i, bytearray.fromhex(h)) for i, (h, _) in enumerate(HEADERS)]
    df = spark.createDataFrame(rows, "blob_id INT, content BINARY")
    got = {r.blob_id: r.format for r in classify.classify_blobs(df).collect()}
    assert got == {i: name for i, (_, name) in enumerate(HEADERS)}


def test_multi_release(spark):
    names = ["p/A.class", "META-INF/versions/11/p/A.class", "META-INF/versions/21/p/A.class",
             "META-INF/versions/011/p/A.class", "META-INF/versions/8/p/A.class", "p/B.txt",
             "META-INF/versions/9/../A.class"]
    entries = spark.createDataFrame(
        [(a, f"{i}", n) for a in (1, 2) for i, n in enumerate(names)],
        "archive_id INT, entry_key STRING, name STRING")
    flags = spark.createDataFrame([(1, True), (2, False)], "archive_id INT, multi_release BOOLEAN")
    got = {(r.archive_id, r.logical_path, r.release)
           for r in classify.multi_release_select(entries, flags, 17).collect()}
    assert got == {(1, "p/A.class", 11), (2, "p/A.class", 0)}


def test_replace_findings_is_idempotent(spark):
    path = shared_folder(spark)
    rows = [(run, f"{run}-{i}") for run in range(20) for i in range(3)]
    schema = "run_id BIGINT, id STRING"
    first = spark.createDataFrame(rows, schema)
    sinks.replace_findings(spark, path, first, first, buckets=3)
    new = spark.createDataFrame([(4, "new")], schema)
    gone = spark.createDataFrame([(4, ""), (5, "")], schema)
    for _ in range(2):
        sinks.replace_findings(spark, path, new, gone, buckets=3)
    got = sorted((r.run_id, r.id) for r in sinks.stored_findings(spark, path, schema).collect())
    assert got == sorted([r for r in rows if r[0] not in (4, 5)] + [(4, "new")])


def test_replace_findings_empties_a_bucket_and_survives_a_failed_commit(spark):
    path, schema = shared_folder(spark), "run_id BIGINT, id STRING"
    two = spark.createDataFrame([(1, "a"), (1, "b")], schema)
    sinks.replace_findings(spark, path, two, two)
    broken = two.withColumn("id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sinks.replace_findings(spark, path, broken, two)
    assert sinks.stored_findings(spark, path, schema).count() == 2
    sinks.replace_findings(spark, path, two.limit(0), two)
    assert sinks.stored_findings(spark, path, schema).count() == 0


def test_replace_findings_keeps_a_run_together_and_spreads_a_large_one(spark, monkeypatch):
    schema, mode, seen = "run_id BIGINT, id STRING, severity STRING", "spark.sql.adaptive.coalescePartitions.enabled", []
    monkeypatch.setattr(sinks, "LARGE_RUN", 100)
    path, was = shared_folder(spark), spark.conf.get(mode)
    rows = [(run, f"{run}-{i}", "LOW") for run in range(1, 30) for i in range(400 if run == 7 else 3)] + [(None, "none", "LOW")]
    runs = spark.createDataFrame([(r,) for r in [*range(1, 29), None, 99]], "run_id BIGINT")
    again = [(7, f"new-{i}", "HIGH") for i in range(300)] + [(8, "8-0", "HIGH"), (9, "not named", "HIGH")]
    named = spark.createDataFrame([(7,), (8,), (10,)], "run_id BIGINT")
    plain = sinks._names

    def names(session, folder):  # once a commit's folder is written: its rows by task
        if sinks.COMMIT in folder:
            files = spark.read.schema(schema).parquet(folder).where("run_id = 7").groupBy(F.input_file_name()).count().collect()
            seen.append(len(files))
        return plain(session, folder)

    monkeypatch.setattr(sinks, "_names", names)
    spark.conf.set(mode, "false")
    try:
        sinks.replace_findings(spark, path, spark.createDataFrame(rows, schema), runs, buckets=2)
        sinks.replace_findings(spark, path, spark.createDataFrame(again, schema), named, buckets=2)
    finally:
        spark.conf.set(mode, was)
    want = [r for r in rows if r[0] and r[0] not in (7, 8, 10, 29)] + [r for r in again if r[0] != 9]
    assert sorted(map(tuple, sinks.stored_findings(spark, path, schema).collect())) == sorted(want)
    assert len(seen) == 2 and min(seen) > 1
    for folder in (n for n in plain(spark, path) if n.startswith(sinks.COMMIT)):  # any other run lies in one file
        files = spark.read.schema(schema).parquet(f"{path}/{folder}").where("run_id <> 7").withColumn("file", F.input_file_name())
        assert files.groupBy("run_id").agg(F.count_distinct("file").alias("n")).where("n > 1").isEmpty()


def test_finding_in_function_against_all_pairs(spark):
    functions = [(p, f, f * 37 % 900, f * 37 % 900 + f * 11 % 700) for p in (1, 2) for f in range(60)]
    hits = [(f"h{i}", i % 2 + 1, i * 13 % 1500, i * 13 % 1500 + i % 4) for i in range(200)]
    fdf = spark.createDataFrame(functions, "project_id INT, result_id INT, start_line BIGINT, end_line BIGINT")
    hdf = spark.createDataFrame(hits, "hit_id STRING, project_id INT, start_line BIGINT, end_line BIGINT")
    got = sorted((r.hit_id, r.result_id) for r in runs.finding_in_function(hdf, fdf, 64).collect())
    assert got == sorted(
        (h, f) for h, hp, hs, he in hits for fp, f, fs, fe in functions
        if hp == fp and fs <= hs and he <= fe)


def test_input_digest(spark):
    import hashlib

    files = spark.createDataFrame(
        [("a", f"f{i:03}", 1) for i in range(500)] + [("b", "f", 1), ("c", "f", 1), ("c", "f", 2), (None, "f", 1)],
        "project_id STRING, logical_path STRING, size_bytes INT")
    got = {r.project_id: (r.file_count, r.input_sha256) for r in quality.input_digest(
        files, "v", ["logical_path", "size_bytes"]).collect()}
    lines = "".join(f"f{i:03}\x001\n" for i in range(500))
    assert got["a"] == (500, hashlib.sha256(f"v\n{lines}".encode()).hexdigest())
    assert got["b"] == got[None] and got["c"] == (2, None)


def test_snapshot_keeps_all_records_in_typed_order(spark):
    rows = spark.createDataFrame([(1, i) for i in (11, 9, 10)] + [(2, 9)], "task_id BIGINT, id INT")
    records = sinks.snapshot_records({"s": (rows, [F.col("id")])})
    got = {(r.task_id, r.part): r.records for r in sinks.snapshot_documents(records, 2).collect()}
    assert got == {(1, 0): '[{"id":9},{"id":10}]', (1, 1): '[{"id":11}]', (2, 0): '[{"id":9}]'}


def test_stored_snapshot_gives_all_parts(spark, tmp_path):
    rows = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 9)], "task_id BIGINT, id INT")
    records = sinks.snapshot_records({"s": (rows, [F.col("id")])})
    sinks.write_snapshot(sinks.snapshot_documents(records, 10), str(tmp_path / "parts"))
    got = {(r.task_id, r.section, r.part): json.loads(r.records) for r in sinks.stored_snapshot(spark, str(tmp_path / "parts")).collect()}
    assert {k: len(v) for k, v in got.items()} == {(1, "s", 0): 10, (1, "s", 1): 10, (1, "s", 2): 5, (2, "s", 0): 1}
    assert [r["id"] for part in range(3) for r in got[1, "s", part]] == list(range(25))


def test_rows_of_a_hot_key_are_numbered_by_many_tasks(spark):
    from cairnlens.functions.keyed import numbered

    rows = [(1, i % 500, str(i)) for i in range(4000)] + [(k, 0, "x") for k in range(2, 30)] + [(None, None, None), (None, 3, "")]
    df = spark.createDataFrame(rows, "k INT, a INT, b STRING").repartition(7)
    folder = shared_folder(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, "k", ["a", "b"], "n", folder).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = sorted((r.n, r.a, r.b) for r in got if r.k == 1)
    assert [n for n, _, _ in hot] == list(range(4000))
    assert [(a, b) for _, a, b in hot] == sorted((r[1], r[2]) for r in rows if r[0] == 1)
    assert sorted(r.n for r in got if r.k is None) == [0, 1] and len(got) == len(rows)
    parts = spark.read.parquet(folder).filter("k = 1").groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 4000


def test_events_are_appended_once(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "task_id BIGINT, event_sequence BIGINT"
    first = spark.createDataFrame([(1, 1), (1, 2), (2, 7)], schema)
    for _ in range(2):
        sinks.append_events(first, path, "a")
    (tmp_path / "log" / "batch=broken").mkdir()
    first.coalesce(1).write.parquet(f"{path}/batch=half")
    for name in (tmp_path / "log" / "batch=half").iterdir():
        if name.name in ("_SUCCESS", "._SUCCESS.crc"):
            name.unlink()  # as if the writer had been lost
    stored = sinks.stored_events(spark, path, schema)
    assert sorted(stored.collect()) == [(1, 1), (1, 2), (2, 7)]
    new = spark.createDataFrame([(1, "b"), (1, "a"), (3, "a")], "task_id BIGINT, name STRING")
    more = sinks.numbered_events(new, stored, ["name"])
    assert sorted((r.task_id, r.name, r.event_sequence) for r in more.collect()) == [(1, "a", 3), (1, "b", 4), (3, "a", 1)]
    sinks.append_events(more.select("task_id", "event_sequence"), path, "half")
    assert sinks.stored_events(spark, path, schema).count() == 6
    assert sinks.stored_events(spark, str(tmp_path / "none"), schema).count() == 0


def test_micro_batches_are_appended_once(spark, tmp_path):
    from cairnlens.streaming import live

    source, path, schema = str(tmp_path / "in"), str(tmp_path / "log"), "task_id BIGINT, event_sequence BIGINT"
    for n in range(2):
        spark.createDataFrame([(n, 1), (n, 2)], schema).coalesce(1).write.mode("append").parquet(source)
        for checkpoint in ("c1", "c2"):  # a lost checkpoint runs the same batches again
            sinks.append_stream(live.tail_events(spark, source, schema), path, str(tmp_path / checkpoint)).awaitTermination()
    assert sorted(sinks.stored_events(spark, path, schema).collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_redaction_reaches_into_arrays(spark):
    from cairnlens.operators.search import redacted_metadata

    logs = spark.createDataFrame(
        [(1, '{"a":[{"password":"p1","b":[1,{"c":{"d":{"e":{"f":"deep"}}}}]}]}'), (2, "{"), (3, None)],
        "id BIGINT, metadata_json STRING")
    got = sorted((r.path, r.shown_value) for r in redacted_metadata(logs).collect())
    assert got == [("$.a[0].b[0]", "1"), ("$.a[0].b[1].c.d.e.f", "deep")]


def test_chunk_helpers_keep_null_keys(spark):
    from cairnlens.functions import chunks

    rows = spark.createDataFrame([(None, 1, 5), (None, 9, 6), (1, 2, 7)], "k INT, o BIGINT, v BIGINT")
    lag = {(r.k, r.o): r.b for r in chunks.lag_value(rows, ["k"], "o", "v", "b", span=4).collect()}
    assert lag == {(None, 1): None, (None, 9): 5, (1, 2): None}
    total = {(r.k, r.o): r.t for r in chunks.prefix_totals(rows, ["k"], "o", {"t": F.col("v")}, span=4).collect()}
    assert total == {(None, 1): 0, (None, 9): 5, (1, 2): 0}
    top = {(r.k, r.o): r.m for r in chunks.prefix_maxima(rows, ["k"], "o", {"m": F.col("v")}, span=4).collect()}
    assert top == {(None, 1): None, (None, 9): 5, (1, 2): None}


@pytest.mark.parametrize("keyword,expected", [("CAFE", 3), ("é", 3), ("x%", 1), ("zz", 0)])
def test_collated_search(spark, keyword, expected):
    from cairnlens.functions.predicates import contains_text

    df = spark.createDataFrame([("Café",), ("CAFE x%",), ("le cafè",), ("tea",)], "n STRING")
    if keyword == "é":  # an accent-free match: every word with an e
        expected = 4
    assert df.filter(contains_text("n", keyword)).count() == expected


def test_streams_resume_where_they_stopped(spark):
    """Two runs over a growing log give what one pass over all of it gives."""
    from cairnlens.operators import metrics
    from cairnlens.streaming import live

    root = shared_folder(spark)
    rows = [(i % 3, i, "t", ["validating", "SCANNING", None, "odd"][(i // 3) % 4], "info", "", "{}", i)
            for i in range(300)]
    schema = ("task_id BIGINT, event_sequence BIGINT, event_type STRING, stage STRING, "
              "severity STRING, message STRING, payload STRING, s BIGINT")
    events = spark.createDataFrame(rows, schema).withColumn(
        "created_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s") * 30)).drop("s")
    as_of = "2024-01-05 00:00:00"
    for part in ("event_sequence < 140", "event_sequence >= 140"):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{root}/log")
        stream = live.tail_events(spark, f"{root}/log")
        got = live.run_available(live.stage_visits(stream, as_of), f"{root}/visits", 2)
    columns = ["task_id", "stage", "started_at", "completed_at"]
    expected = metrics.stage_intervals(events, as_of).select(*columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, expected.collect()))
    assert got.count() > 0


def test_failure_bursts_by_hand(spark):
    from cairnlens.streaming import live

    root = shared_folder(spark)
    # (second, failed): window 60 s from the first attempt, three failures block 300 s
    attempts = [(0, True), (10, False), (20, True), (59, True), (100, True), (358, True),
                (359, True), (400, True), (418, True), (419, True), (420, True), (900, False)]
    df = spark.createDataFrame([(7, i, s, f) for i, (s, f) in enumerate(attempts)],
                               "client BIGINT, attempt_id BIGINT, s BIGINT, failed BOOLEAN")
    base = 1_704_067_200
    df.withColumn("attempted_at", F.timestamp_seconds(F.col("s") + base)).drop("s").coalesce(1).write.parquet(f"{root}/a")
    stream = live.tail_events(
        spark, f"{root}/a", "client BIGINT, attempt_id BIGINT, failed BOOLEAN, attempted_at TIMESTAMP")
    got = live.run_available(live.failure_bursts(stream, 3, 60, 300), f"{root}/out", 2)
    seconds = [tuple(int(x.timestamp()) - base for x in (r.window_started_at, r.blocked_at, r.blocked_until))
               for r in got.collect()]
    # after the block ends at 359 the window is 359..419: 359, 400, 418 are three failures
    assert sorted(seconds) == [(0, 59, 359), (359, 418, 718)]


def test_lagging_worker_is_reported_over_many_batches(spark):
    from cairnlens.streaming import live

    root = shared_folder(spark)
    base = 1_704_067_200
    got = None
    for worker, second in (("A", 100), ("B", 99), ("A", 300), ("A", 600)):
        beat = spark.createDataFrame([(worker, "ready", base + second)], "worker_owner STRING, status STRING, s BIGINT")
        beat.select("worker_owner", "status", F.timestamp_seconds("s").alias("last_checked_at")).write.mode("append").parquet(f"{root}/beats")
        stream = live.tail_events(spark, f"{root}/beats", "worker_owner STRING, status STRING, last_checked_at TIMESTAMP")
        got = live.run_available(live.stale_workers(stream), f"{root}/out", 2)
    rows = sorted((r.worker_owner, int(r.last_checked_at.timestamp()) - base, r.reason) for r in got.collect())
    assert ("B", 99, "stale") in rows and ("A", 600, "stale") not in rows


def test_events_come_out_in_order_after_any_arrival(spark):
    import datetime
    import random

    from cairnlens.streaming import live

    root = shared_folder(spark)
    at = datetime.datetime(2024, 1, 1)
    schema = "task_id BIGINT, event_sequence BIGINT, event_type STRING, created_at TIMESTAMP"

    def deliver(rows):
        data = [(task, n, f"e{n}", at + datetime.timedelta(seconds=n)) for task, n in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{root}/log")

    def run(patience):
        stream = live.tail_events(spark, f"{root}/log", schema)
        return live.run_available(live.ordered_batches(stream, 1, 10, patience), f"{root}/out", 2, False).collect()

    draw = random.Random(2)
    rows = [(task, n) for task in (1, 2) for n in range(1, 41)]
    draw.shuffle(rows)
    rows = [r for r in rows if r != (2, 15)]
    deliver(rows[:30] + rows[:5])
    first = run(3600)
    deliver(rows[30:])
    deliver(rows[20:40])
    both = run(3600)
    assert len(first) < len(both)
    of = lambda found, task: [r for r in sorted(found, key=lambda r: (r.batch is None, r.batch, r.position)) if r.task_id == task]
    one, two = of(both, 1), of(both, 2)
    assert [r.event_sequence for r in one] == list(range(1, 41))
    assert [(r.batch, r.position) for r in one] == [(i // 10, i % 10 + 1) for i in range(40)]
    assert [r.event_sequence for r in two] == list(range(1, 15)) and not any(r.skipped or r.late for r in both)


def test_gaps_are_given_up_after_the_patience(spark):
    import datetime
    import time

    from cairnlens.streaming import live

    root = shared_folder(spark)
    at = datetime.datetime(2024, 1, 1)
    schema = "task_id BIGINT, event_sequence BIGINT, event_type STRING, created_at TIMESTAMP"

    def step(*numbers):
        rows = [(1, n, "e", at) for n in numbers]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/log")
        stream = live.tail_events(spark, f"{root}/log", schema)
        found = live.run_available(live.ordered_batches(stream, 1, 100, 1), f"{root}/out", 1, False).collect()
        return sorted((r.event_sequence, r.skipped, r.late) for r in found)

    step(1, 2, 6, 7)
    time.sleep(1.5)
    got = step(8)
    assert got[:5] == [(1, 0, False), (2, 0, False), (6, 3, False), (7, 0, False), (8, 0, False)]
    got = step(4, 4, 2, 9)
    assert got == [(1, 0, False), (2, 0, False), (4, 0, True), (6, 3, False), (7, 0, False), (8, 0, False), (9, 0, False)]


def test_blobs_are_read_in_blocks(spark, tmp_path):
    import hashlib
    import resource

    from cairnlens.sources.blobs import BlobReader

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "empty").write_bytes(b"")
    (tmp_path / "one").write_bytes(b"one")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    with open(tmp_path / "large", "wb") as f:  # sparse: takes no disk
        f.truncate((2 << 30) + 5)
    reader = BlobReader(f"file:{tmp_path}", "*")
    parts = reader.partitions()
    assert sorted(len(p.paths) for p in parts) == [1, 2]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    assert {r["path"].rsplit("/", 1)[1]: r["size_bytes"] for r in rows} == {"empty": 0, "one": 3, "large": (2 << 30) + 5}
    found = documents.scan_blobs(spark, str(tmp_path / "a")).collect()
    assert [(r.size_bytes, r.sha256) for r in found] == [(0, hashlib.sha256(b"").hexdigest())]
    assert documents.scan_blobs(spark, str(tmp_path), "none*").count() == 0


CLEANED = [
    ('{"b":2,"a":{"Storage_Key":"x","api key":1,"ok":[{"PASS-PHRASE":1,"é":null}]}}', '{"a":{"ok":[{"é":null}]},"b":2}'),
    ('{"n":1.500,"big":123456789012345678901234567890,"e":1E+5}', '{"big":123456789012345678901234567890,"e":1E+5,"n":1.500}'),
    ('{"a":1,"a":2}', '{"a":2}'), ('"<\u2028\ud800\t"', '"\\u003c\\u2028\ufffd\\t"'), (" [ ] ", "[]"), ("-0", "-0"),
    ("[" * 32 + "1" + "]" * 32, "[" * 32 + "1" + "]" * 32), ("[" * 33 + "1" + "]" * 33, "null"), ("[" * 5000, "null"),
    ('["' + "x" * 65536 + '"]', '["' + "x" * 65536 + '"]'), ('["' + "x" * 65537 + '"]', "null"),
    ('["' + "x" * (1 << 20) + '"]', "null"), ("[" + ",".join("1" * 10001) + "]", "null"), ("NaN", "null"), ("{} {}", "null"),
    ("", "null"), (None, "null"), ("{'a':1}", "null"), ('{"' + "k" * 1025 + '":1}', "null"),
]


def test_report_json_is_cleaned(spark):
    from cairnlens.functions.report_text import clean_json

    texts = [t.replace("\u2028", "\\u2028").replace("\ud800", "\\ud800").replace("\t", "\\t") if t else t for t, _ in CLEANED]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING").select("id", clean_json("t").alias("c"))
    got = {r.id: r.c for r in df.collect()}
    assert [got[i] for i in range(len(CLEANED))] == [want for _, want in CLEANED]
    assert df.select(clean_json(F.lit("x"), "[]")).first()[0] == "[]"


def test_report_json_is_indented(spark):
    from cairnlens.functions.report_text import readable_json

    texts = ['{"b":[1,{"x":"a,{\\"}b"}],"a":{}}', '[[],{"k":[[]]}]', " 1.50 ", "tru", None, '"a:b"']
    want = ['{\n  "b": [\n    1,\n    {\n      "x": "a,{\\"}b"\n    }\n  ],\n  "a": {}\n}',
            '[\n  [],\n  {\n    "k": [\n      []\n    ]\n  }\n]', "1.50", "null", "null", '"a:b"']
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    got = {r.id: r.c for r in df.select("id", readable_json("t").alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_messages_get_titles(spark):
    from cairnlens.functions.report_text import display_message

    rows = [("c", "cwe-78-command", " system() "), ("c", "cwe-78-command", " "), ("java", "cwe-78-command", " as is "),
            ("diagnostic", "parser_no_ast", "解析器未生成语法树"), ("python", None, "m"), (None, "x", None)]
    df = spark.createDataFrame(rows, "checker STRING, code STRING, message STRING")
    got = [r[0] for r in df.select(display_message("checker", "code", "message")).collect()]
    assert got == ["命令注入风险（外部输入未净化） — system()", "命令注入风险（外部输入未净化）", " as is ", "解析器未生成语法树", "m", ""]


def test_fragments_from_small_chunks(spark):
    import random

    from cairnlens.operators import search

    draw = random.Random(4)
    texts = {1: "".join(draw.choice("ab\né") for _ in range(500)), 2: "", 3: "one line"}
    sources = spark.createDataFrame(list(texts.items()), "project_id INT, text STRING")
    ranges = [(p, n, draw.randrange(600), draw.randrange(0, 200)) for p in (1, 2, 3, 4) for n in range(30)] + [(1, 0, 3, 5), (1, 0, 3, 5)]
    functions = spark.createDataFrame(ranges, "project_id INT, result_id INT, offset_bytes INT, length_bytes INT")
    binary = sources.select("project_id", F.col("text").cast("binary").alias("content"))
    got = sorted((r.project_id, r.result_id, bytes(r.fragment)) for r in search.source_fragments(functions, binary, 7).collect())
    assert got == sorted((p, n, texts[p].encode()[a:a + m]) for p, n, a, m in ranges if p in texts)
    spans = [(p, n, 1 + draw.randrange(150), draw.randrange(0, 60)) for p in (1, 2, 3) for n in range(30)]
    lines = spark.createDataFrame([(p, n, a, a + m - 1) for p, n, a, m in spans], "project_id INT, result_id INT, start_line INT, end_line INT")
    got = sorted((r.project_id, r.result_id, r.fragment) for r in search.source_line_slices(lines, sources, 4).collect())
    assert got == sorted((p, n, "\n".join(texts[p].split("\n")[a - 1:a - 1 + m])) for p, n, a, m in spans)


def test_late_events_come_out_once(spark):
    import datetime

    from cairnlens.streaming import live

    folder = shared_folder(spark)
    at = datetime.datetime(2024, 1, 1)
    schema = "task_id BIGINT, event_sequence BIGINT, stage STRING, created_at TIMESTAMP"
    batches = [[(1, 100), (2, 90)], [(3, 79), (4, 81), (5, 200)], [(6, 150), (7, 185), (8, None)], [(9, 10)]]
    for rows in batches:
        data = [(1, n, "SCANNING", None if s is None else at + datetime.timedelta(seconds=s)) for n, s in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = live.tail_events(spark, f"{folder}/log", schema)
        in_time, late = live.split_late(stream, "created_at", 20, folder)
    assert sorted(r.event_sequence for r in late.collect()) == [3, 6, 9]
    assert sorted(r.event_sequence for r in in_time.collect()) == [1, 2, 4, 5, 7, 8]
    counts = spark.read.parquet(f"{folder}/late").groupBy("batch").count()
    assert sum(r["count"] for r in counts.collect()) == 3


def test_two_writers_at_once_both_succeed_and_old_folders_go(spark):
    from concurrent.futures import ThreadPoolExecutor

    path, schema = shared_folder(spark), "run_id BIGINT, id STRING"

    def write(run):
        for n in range(3):
            rows = spark.createDataFrame([(run, f"{run}-{n}")], schema)
            sinks.replace_findings(spark, path, rows, rows, buckets=2)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, [1, 2, 3]))
    want = [(1, "1-2"), (2, "2-2"), (3, "3-2")]
    assert sorted(sinks.stored_findings(spark, path, schema).collect()) == want
    assert sinks.expire_findings(spark, path) == []
    gone = sinks.expire_findings(spark, path, older_than_seconds=-5)
    assert len([n for n in gone if n.startswith(sinks.LIST)]) == 8
    assert sorted(sinks.stored_findings(spark, path, schema).collect()) == want
    left = [n for n in sinks._names(spark, path) if n.startswith(sinks.COMMIT)]
    assert 1 <= len(left) <= 2 and sinks.expire_findings(spark, f"{path}-none") == []
