"""Queries: diagnostics, snapshots, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions import report_text, text
from cairnlens.operators import nested, reports
from cairnlens.plans.registry import query
from cairnlens.session import shared_folder
from cairnlens.sources import documents, sinks

def _diagnostics_sql() -> str:
    """All items with their state, met with the table of reportable states."""
    kinds = ", ".join(f"('{s}', '{v}', '{c}', '{k}', '{t}')" for s, v, c, k, t in vocab.DIAGNOSTIC_KINDS)
    return f"""
SELECT i.task_id, k.category, i.source, i.logical_path, coalesce(nullif(i.own_code, ''), k.code) AS code,
       coalesce(nullif(i.own_text, ''), k.text) AS message, i.created_at, i.stable_id
FROM (
  FROM tasks SELECT id AS task_id, 'task' AS source, status AS state, NULL AS logical_path,
       error_code AS own_code, error_message AS own_text, created_at, id::VARCHAR AS stable_id
  UNION ALL BY NAME
  FROM analyzer_runs SELECT task_id, 'analyzer_run' AS source, status AS state, error_code AS own_code,
       error_message AS own_text, created_at, id::VARCHAR AS stable_id
  UNION ALL BY NAME
  FROM file_nodes SELECT task_id, 'file_node' AS source, extraction_status AS state, logical_path,
       error_code AS own_code, error_message AS own_text, created_at, id::VARCHAR AS stable_id
  UNION ALL BY NAME
  FROM decompile_results SELECT task_id, 'decompile_result' AS source, status AS state, created_at,
       id AS stable_id WHERE deleted_at IS NULL
  UNION ALL BY NAME
  FROM task_events SELECT task_id, 'task_event' AS source, severity AS state, message AS own_text,
       created_at, event_sequence::VARCHAR AS stable_id
) i JOIN (VALUES {kinds}) AS k(source, state, category, code, text) USING (source, state)"""


DIAGNOSTICS = _diagnostics_sql()


def _diagnostics(d):
    return reports.diagnostics_union(
        d.task_events, d.file_nodes, d.decompile_results, d.analyzer_runs, d.tasks
    )


@query("diagnostics_union", DIAGNOSTICS + " ORDER BY created_at, stable_id")
def _(d):
    return _diagnostics(d).orderBy("created_at", "stable_id")


@query("issues_by_class", f"""
SELECT task_id, category, source, count(*) AS issue_count FROM ({DIAGNOSTICS}) GROUP BY ALL""")
def _(d):
    return reports.issue_counts(_diagnostics(d))


@query("diagnostics_page", f"""
SELECT task_id, category, source, stable_id, position, n > 5 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at, stable_id, source)
         AS position, count(*) OVER (PARTITION BY task_id) AS n FROM ({DIAGNOSTICS}))
WHERE position <= 5""")
def _(d):
    from cairnlens.operators.findings import truncate_per_task

    order = [F.col("created_at"), F.col("stable_id"), F.col("source")]
    return truncate_per_task(_diagnostics(d), order, 5).select(
        "task_id", "category", "source", "stable_id", "position", "truncated"
    )


def _records(d):
    found = d.vulnerability_findings.select("task_id", "id", "severity", "vulnerability_id")
    failed = d.analyzer_runs.filter("status IN ('failed', 'timed_out')").select(
        "task_id", "id", "status"
    )
    order = [F.col("id")]
    return sinks.snapshot_records({"findings": (found, order), "failed": (failed, order)})


SNAPSHOT = """
SELECT task_id, 'findings' AS section, count(*) AS record_count, concat('[', string_agg(
    concat('{"id":"', id, '","severity":"', severity, '","vulnerability_id":"', vulnerability_id,
           '"}'), ',' ORDER BY id), ']') AS records
FROM vulnerability_findings GROUP BY task_id
UNION ALL
SELECT task_id, 'failed', count(*), concat('[', string_agg(
    concat('{"id":', id, ',"status":"', status, '"}'), ',' ORDER BY id), ']')
FROM analyzer_runs WHERE status IN ('failed', 'timed_out') GROUP BY task_id"""


@query("snapshot_counts", f"""
SELECT task_id, section, record_count, record_count > 6 AS over_limit FROM ({SNAPSHOT})""")
def _(d):
    return sinks.snapshot_counts(_records(d), 6)


PARTS = """
SELECT task_id, 'findings' AS section, record, row_number() OVER (PARTITION BY task_id ORDER BY id) - 1 AS position
FROM (SELECT task_id, id, concat('{"id":"', id, '","severity":"', severity, '","vulnerability_id":"', vulnerability_id, '"}') AS record
      FROM vulnerability_findings)
UNION ALL
SELECT task_id, 'failed', record, row_number() OVER (PARTITION BY task_id ORDER BY id) - 1
FROM (SELECT task_id, id, concat('{"id":', id, ',"status":"', status, '"}') AS record
      FROM analyzer_runs WHERE status IN ('failed', 'timed_out'))"""


@query("write_snapshot", f"""
SELECT task_id, section, (position // 3)::INTEGER AS part, concat('[', string_agg(record, ',' ORDER BY position), ']') AS records
FROM ({PARTS}) GROUP BY ALL""")
def _(d):
    path = shared_folder(d.spark)
    sinks.write_snapshot(sinks.snapshot_documents(_records(d), part_records=3), path)
    return sinks.stored_snapshot(d.spark, path)


@query("replace_findings", """
SELECT f.run_id, f.id, CASE WHEN r.status = 'partial' THEN 'HIGH' ELSE f.severity END AS severity
FROM rule_findings f JOIN rule_runs r ON r.id = f.run_id WHERE r.status <> 'failed'""")
def _(d):
    """Publishes all runs, then partial runs changed and failed runs without findings."""
    path = shared_folder(d.spark)
    first = d.rule_findings.select("run_id", "id", "severity")
    sinks.replace_findings(d.spark, path, first, d.rule_findings, buckets=4)
    states = d.rule_runs.select(F.col("id").alias("run_id"), "status")
    again = first.join(states.filter("status = 'partial'"), "run_id", "left_semi").withColumn(
        "severity", F.lit("HIGH")
    )
    runs = states.filter("status IN ('partial', 'failed')")
    for _ in range(2):  # the second time must change nothing
        sinks.replace_findings(d.spark, path, again, runs, buckets=4)
    stored = sinks.stored_findings(d.spark, path, "run_id BIGINT, id STRING, severity STRING")
    return stored.select("run_id", "id", "severity")


@query("append_events", """
SELECT id AS task_id, event_sequence, 'task.updated' AS event_type,
  CASE WHEN status = 'FAILED' OR error_code IS NOT NULL THEN 'error'
       WHEN status IN ('PARTIAL_SUCCEEDED', 'CANCEL_REQUESTED') OR risk_level IN ('HIGH', 'CRITICAL')
       THEN 'warning' ELSE 'info' END AS severity
FROM tasks WHERE deleted_at IS NULL""")
def _(d):
    path = shared_folder(d.spark)
    rows = sinks.event_rows(
        d.tasks.filter("deleted_at IS NULL"), "task.updated", "Updated.", "1999-06-15 00:00:00"
    )
    for _ in range(2):  # the second time must change nothing
        sinks.append_events(rows, path, "updated")
    return sinks.stored_events(d.spark, path, rows.schema).select(
        "task_id", "event_sequence", "event_type", "severity"
    )


@query("numbered_events", """
SELECT a.task_id, a.id, a.status, coalesce(e.last, 0) + row_number() OVER (PARTITION BY a.task_id ORDER BY a.id) AS event_sequence
FROM analyzer_runs a LEFT JOIN (SELECT task_id, max(event_sequence) AS last FROM task_events GROUP BY 1) e ON e.task_id = a.task_id""")
def _(d):
    """Each analyzer run as a further event of its task."""
    return sinks.numbered_events(d.analyzer_runs.select("task_id", "id", "status"), d.task_events, ["id"])


@query("scan_table", """
SELECT 'lineitem' AS table_name, count(*) AS row_count, sum(l_partkey)::BIGINT AS key_sum FROM lineitem
UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders
UNION ALL SELECT 'events', count(*), sum(event_id)::BIGINT FROM events""")
def _(d):
    parts = [("lineitem", "l_partkey"), ("orders", "o_orderkey"), ("events", "event_id")]
    out = None
    for name, key in parts:
        one = d.table(name).agg(F.count("*").alias("row_count"), F.sum(key).alias("key_sum")).select(
            F.lit(name).alias("table_name"), "row_count", "key_sum"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_blobs", """
WITH held AS (
  SELECT doc_id % 64 AS blob, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1)
SELECT 'blob=' || blob AS folder, strlen(content) AS size_bytes, sha256(content) AS sha256,
       'blobs/sha256/' || substr(sha256(content), 1, 2) || '/' || sha256(content) AS storage_key
FROM held""")
def _(d):
    """Documents written to 64 files, one task a file, and found again."""
    path = shared_folder(d.spark)
    texts = d.table("documents").select("doc_id", (F.col("doc_id") % 64).alias("blob"), "text")
    texts.repartition("blob").sortWithinPartitions("blob", "doc_id").select("blob", "text").write.partitionBy("blob").text(path)
    return documents.scan_blobs(d.spark, path, "*.txt").select(
        text.base_name(text.parent_path("path")).alias("folder"), "size_bytes", "sha256", "storage_key"
    )


@query("scan_reports", """
SELECT count(*) AS report_count,
  count(*) FILTER (NOT json_valid(document)) AS broken_count,
  sum(json_array_length(CASE WHEN json_valid(document) THEN document END, '$.Results'))::BIGINT
    AS result_count
FROM report_documents""")
def _(d):
    path = shared_folder(d.spark)
    # packed files cannot be split, so none holds too much for one task
    packed = {"compression": "gzip", "maxRecordsPerFile": 200_000}
    d.report_documents.select(F.col("document").alias("value")).write.options(**packed).text(path)
    found = documents.scan_reports(d.spark, path, one_per_file=False)
    # the whole row is read, as a projection without data columns would skip parsing
    return found.select(
        F.col("_corrupt").isNotNull().alias("broken"),
        F.coalesce(F.size("Results"), F.lit(0)).alias("n"),
        F.col("SchemaVersion"),
    ).agg(
        F.count("*").alias("report_count"),
        F.count_if("broken").alias("broken_count"),
        F.sum(F.when(~F.col("broken") & (F.col("n") > 0), F.col("n"))).alias("result_count"),
    )


@query("scan_program_index", """
SELECT 'f' || p_partkey AS name, '0x' || p_partkey AS address, '0x' || (p_partkey + 1) AS callee,
       p_size % 4 <> 3 AS counts_valid
FROM part""")
def _(d):
    path = shared_folder(d.spark)
    address = F.concat(F.lit("0x"), F.col("p_partkey"))
    callee = F.concat(F.lit("0x"), F.col("p_partkey") + 1)
    partial = F.col("p_size") % 4 >= 2
    document = F.struct(
        F.when(partial, "partial").otherwise("complete").alias("completeness"),
        F.when(F.col("p_size") % 4 == 2, 2).otherwise(1).alias("candidate_function_count"),
        F.lit(1).alias("decompiled_function_count"),
        F.array(
            F.struct(
                F.concat(F.lit("f"), "p_partkey").alias("name"), address.alias("address"),
                F.concat(F.lit("f"), "p_partkey", F.lit(".c")).alias("source_file"),
            )
        ).alias("functions"),
        F.array(
            F.struct(
                address.alias("caller_address"), callee.alias("callee_address"),
                F.lit(False).alias("external"),
            )
        ).alias("call_edges"),
    )
    d.part.select(F.to_json(document).alias("value")).write.text(path)
    from cairnlens.operators.graph import program_index_counts

    index = program_index_counts(documents.scan_program_index(d.spark, path, one_per_file=False))
    rows = index.select("counts_valid", F.explode("functions").alias("f"), "call_edges")
    return rows.select(
        "f.name", "f.address", F.explode("call_edges").alias("e"), "counts_valid"
    ).select("name", "address", F.col("e.callee_address").alias("callee"), "counts_valid")


@query("scan_class_index", """
SELECT 'k' || p_partkey AS class_key, m.n AS method_number, CASE WHEN m.n IS NOT NULL
    THEN concat('m', m.n) END AS name, CASE WHEN m.n IS NOT NULL THEN m.n * 8 END AS offset_bytes
FROM part LEFT JOIN (VALUES (1), (2), (3)) AS m(n) ON m.n <= p_size % 4""")
def _(d):
    path = shared_folder(d.spark)
    numbers = F.slice(F.array(*map(F.lit, (1, 2, 3))), 1, F.col("p_size") % 4)
    methods = F.transform(
        numbers,
        lambda n: F.struct(
            n.cast("string").alias("method_key"), F.concat(F.lit("m"), n).alias("name"),
            F.struct((n * 8).alias("offset_bytes"), n.alias("size_bytes")).alias("code"),
        ),
    )
    document = F.struct(
        F.concat(F.lit("k"), "p_partkey").alias("class_key"), methods.alias("methods")
    )
    d.part.select(F.to_json(document).alias("value")).write.text(path)
    rows = nested.class_methods(documents.scan_class_index(d.spark, path, one_per_file=False))
    return rows.select(
        "class_key", F.col("method_key").cast("int").alias("method_number"), "name",
        F.col("code.offset_bytes").alias("offset_bytes"),
    )


_TITLES = ", ".join(
    f"('{checker}', '{code}', '{title}')" for checker, pairs in vocab.MESSAGE_TITLES.items() for code, title in pairs
)


@query("display_messages", f"""
SELECT m.id, CASE WHEN t.title IS NULL THEN m.message WHEN trim(m.message) IN ('', t.title) THEN t.title
                  ELSE t.title || ' — ' || trim(m.message) END AS message
FROM checker_messages m LEFT JOIN (VALUES {_TITLES}) t(checker, code, title) ON t.checker = m.checker AND t.code = m.code""")
def _(d):
    return d.checker_messages.select("id", report_text.display_message("checker", "code", "message").alias("message"))


@query("clean_report_json", r"""
SELECT id, CASE kind WHEN 0 THEN '{"a":"\u003cx\u003e\u0026","b":1.50}'
                     WHEN 1 THEN '[{"n":12345678901234567890' || k || '},null,true]'
                     WHEN 4 THEN '{"k":{"v":[1,2.0,1e5,' || k || ']}}'
                     WHEN 5 THEN '"text é ' || k || '"'
                     WHEN 7 THEN '{"Z":' || k || ',"y":[],"z":{},"é":-0.10}' ELSE 'null' END AS document
FROM evidence_documents""")
def _(d):
    return d.evidence_documents.select("id", report_text.clean_json("document").alias("document"))


@query("readable_report_json", r"""
SELECT id, replace(CASE kind WHEN 0 THEN '{|  "b": 1.50,|  "a": "<x>&",|  "storage_key": "' || k || '"|}'
                     WHEN 1 THEN '[|  {|    "Pass-Word": "p",|    "n": 12345678901234567890' || k || '|  },|  null,|  true|]'
                     WHEN 4 THEN '{|  "k": {|    "API key": {|      "deep": 1|    },|    "v": [|      1,|      2.0,|      1e5,|      '
                                 || k || '|    ]|  },|  "Secret": []|}'
                     WHEN 5 THEN '"text é ' || k || '"'
                     WHEN 7 THEN '{|  "z": {},|  "y": [],|  "é": -0.10,|  "Z": ' || k || '|}' ELSE 'null' END, '|', chr(10)) AS document
FROM evidence_documents""")
def _(d):
    return d.evidence_documents.select("id", report_text.readable_json("document").alias("document"))
