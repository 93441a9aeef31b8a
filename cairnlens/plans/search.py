"""Queries: search, views, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlens.functions import predicates
from cairnlens.operators import search
from cairnlens.plans.registry import query

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "1999-06-15 00:00:00"

TASK_VIEW = """SELECT t.*, u.public_id AS creator_public_id, u.username AS creator_username,
       u.display_name AS creator_name, up.display_name AS upload_name,
       b.size_bytes AS blob_size_bytes, b.sha256 AS blob_sha256
FROM tasks t JOIN users u ON u.id = t.created_by JOIN uploads up ON up.id = t.upload_id
JOIN blobs b ON b.id = t.blob_id"""


def _task_view(d):
    return search.task_view(d.tasks, d.users, d.uploads, d.blobs)


@query("task_view", f"""
SELECT id, name, creator_public_id, upload_name, blob_size_bytes, blob_sha256 FROM ({TASK_VIEW})""")
def _(d):
    return _task_view(d).select(
        "id", "name", "creator_public_id", "upload_name", "blob_size_bytes", "blob_sha256"
    )


@query("task_search", f"""
SELECT id, name, status, upload_name FROM ({TASK_VIEW})
WHERE (lower(name) LIKE '%0!%!_DONE%' ESCAPE '!' OR contains(lower(name), '0%_done')
       OR contains(lower(upload_name), '0%_done'))
  AND status = 'FAILED' AND lower(COALESCE(NULLIF(root_format, ''), 'unknown')) = 'unknown'
  AND (contains(lower(creator_name), 'customer#0000000')
       OR contains(lower(creator_username), 'customer#0000000'))
  AND created_at >= TIMESTAMP '1995-02-01' AND created_at < TIMESTAMP '2000-12-31'""")
def _(d):
    found = search.task_search(
        _task_view(d), keyword="0%_DONE", status="FAILED", kind="unknown",
        creator="CUSTOMER#0000000", created_from="1995-02-01", created_to="2000-12-30",
    )
    return found.select("id", "name", "status", "upload_name")


@query("keyword_contains", """
SELECT id, name FROM tasks WHERE contains(lower(name), '100%_done')""")
def _(d):
    return d.tasks.filter(predicates.contains_text("name", "100%_Done")).select("id", "name")


@query("input_type_filter", """
SELECT id, root_format FROM tasks
WHERE lower(COALESCE(NULLIF(root_format, ''), 'unknown')) IN ('pe32', 'unknown')""")
def _(d):
    return d.tasks.filter(predicates.input_type().isin("pe32", "unknown")).select(
        "id", "root_format"
    )


@query("tag_filter", """
SELECT id, tags FROM tasks
WHERE list_contains(CAST(json(COALESCE(tags, '[]')) AS VARCHAR[]), 't3')""")
def _(d):
    return d.tasks.filter(predicates.has_tag("tags", "t3")).select("id", "tags")


@query("date_range_filter", """
SELECT id, created_at FROM tasks
WHERE created_at >= TIMESTAMP '1996-03-01' AND created_at < TIMESTAMP '1996-04-11'""")
def _(d):
    between = predicates.created_between("created_at", "1996-03-01", "1996-04-10")
    return d.tasks.filter(between).select("id", "created_at")


@query("findings_by_severity", """
SELECT id, task_id, vulnerability_id FROM vulnerability_findings
WHERE severity = 'CRITICAL' AND task_id = 7""")
def _(d):
    found = d.vulnerability_findings.filter("severity = 'CRITICAL' AND task_id = 7")
    return found.select("id", "task_id", "vulnerability_id")


@query("rule_findings_search", """
SELECT id, cwe, severity FROM rule_findings
WHERE cwe = 'CWE-120' AND severity = 'HIGH' AND contains(lower(function_name), 'fn_1')
  AND contains(logical_path, '/p2/')
  AND (contains(lower(callable_name), 'l1') OR contains(lower(type_name), 'l1'))""")
def _(d):
    return search.rule_findings_search(
        d.rule_findings, cwe="CWE-120", severity="HIGH", function="FN_1", file="/p2/",
        callable_text="L1",
    ).select("id", "cwe", "severity")


AUDIT_VIEW = """SELECT a.*, u.public_id AS actor_public_id, u.username AS actor_username,
       u.display_name AS actor_name
FROM audit_logs a LEFT JOIN users u ON u.id = a.actor_user_id"""


@query("audit_with_actor", f"""
SELECT id, action, outcome, actor_public_id, actor_name FROM ({AUDIT_VIEW})""")
def _(d):
    return search.audit_with_actor(d.audit_logs, d.users).select(
        "id", "action", "outcome", "actor_public_id", "actor_name"
    )


@query("audit_search", f"""
SELECT id, action, outcome, actor_username FROM ({AUDIT_VIEW})
WHERE action = 'error' AND outcome = 'failure'
  AND (actor_public_id = 'machinery' OR contains(lower(actor_username), 'machinery')
       OR contains(lower(actor_name), 'machinery'))
  AND created_at >= TIMESTAMP '2024-01-03 00:00:00'
  AND created_at <= TIMESTAMP '2024-01-25 12:00:00'""")
def _(d):
    view = search.audit_with_actor(d.audit_logs, d.users)
    return search.audit_search(
        view, action="error", outcome="failure", actor="machinery",
        created_from="2024-01-03 00:00:00", created_to="2024-01-25 12:00:00",
    ).select("id", "action", "outcome", "actor_username")


@query("user_search", f"""
SELECT id, username, role, CASE WHEN status = 'active' AND locked_until > TIMESTAMP '{EVENTS_AS_OF}'
         THEN 'locked' ELSE status END AS account_status
FROM users WHERE role = 'BUILDING' AND contains(lower(username), 'customer#00')
  AND status = 'active' AND locked_until > TIMESTAMP '{EVENTS_AS_OF}'""")
def _(d):
    return search.user_search(
        d.users, EVENTS_AS_OF, keyword="Customer#00", role="BUILDING", status="locked"
    ).select("id", "username", "role", "account_status")


@query("user_accounts", f"""
SELECT CASE WHEN status = 'active' AND locked_until > TIMESTAMP '{EVENTS_AS_OF}'
            THEN 'locked' ELSE status END AS account_status, role, count(*) AS n
FROM users GROUP BY ALL""")
def _(d):
    users = search.user_search(d.users, EVENTS_AS_OF)
    return users.groupBy("account_status", "role").agg(F.count("*").alias("n"))


@query("sample_relation", f"""
SELECT id, CASE WHEN sample_deleted_at IS NOT NULL THEN 'deleted'
     WHEN sample_expires_at <= TIMESTAMP '{ORDERS_AS_OF}' THEN 'expired' ELSE 'retained' END
     AS relation
FROM tasks WHERE deleted_at IS NULL""")
def _(d):
    return d.tasks.filter("deleted_at IS NULL").select(
        "id", predicates.sample_relation(ORDERS_AS_OF).alias("relation")
    )


SEVERITY = """CASE WHEN status = 'FAILED' OR error_code IS NOT NULL THEN 'error'
  WHEN status IN ('PARTIAL_SUCCEEDED', 'CANCEL_REQUESTED') OR risk_level IN ('HIGH', 'CRITICAL')
  THEN 'warning' ELSE 'info' END"""


@query("event_severity", f"SELECT id, {SEVERITY} AS severity FROM tasks")
def _(d):
    return d.tasks.select("id", predicates.event_severity().alias("severity"))


@query("risk_alerts", f"""
SELECT id, {SEVERITY} AS severity FROM tasks WHERE {SEVERITY} IN ('warning', 'error')""")
def _(d):
    rows = d.tasks.select("id", predicates.event_severity().alias("severity"))
    return rows.filter(F.col("severity").isin("warning", "error"))


@query("fixable_findings", """
SELECT id, fixed_version FROM vulnerability_findings
WHERE NULLIF(trim(fixed_version), '') IS NOT NULL""")
def _(d):
    return d.vulnerability_findings.filter(predicates.fixable()).select("id", "fixed_version")


@query("recent_events", f"""
SELECT task_id, event_sequence FROM task_events
WHERE created_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 168 HOUR""")
def _(d):
    return d.task_events.filter(predicates.recent("created_at", EVENTS_AS_OF)).select(
        "task_id", "event_sequence"
    )


@query("json_path_filter", """
SELECT id, task_id FROM jobs
WHERE kind = 'decompile' AND status IN ('queued', 'leased', 'running', 'cancel_requested')
  AND json_extract_string(payload, '$.target.file_node_id') = '12'""")
def _(d):
    return search.jobs_for_node(d.jobs, "12").select("id", "task_id")


@query("single_source_jobs", """
SELECT id, task_id FROM jobs
WHERE kind = 'image' AND status IN ('queued', 'leased', 'running', 'cancel_requested')
  AND json_array_length(json_extract(payload, '$.sources')) = 1
  AND json_extract_string(payload, '$.sources[0].image_logical_path') = '/img/1'""")
def _(d):
    return search.single_source_jobs(d.jobs, "/img/1").select("id", "task_id")


@query("project_events", """
SELECT task_id, event_sequence, event_type FROM task_events
WHERE event_type LIKE 'p%' AND json_extract_string(payload, '$.k')
      IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 5000)""")
def _(d):
    ids = d.supplier.filter("s_acctbal < 5000").select(F.col("s_suppkey").alias("id"))
    return search.project_events(d.task_events, "p", ids, ["$.k", "$.project_id"]).select(
        "task_id", "event_sequence", "event_type"
    )


@query("upload_intake_view", """
SELECT u.id, u.status, b.sha256, b.state AS blob_state, p.input_category, p.detected_format,
       p.validation_status
FROM uploads u LEFT JOIN blobs b ON b.id = u.blob_id
LEFT JOIN intake_profiles p ON p.upload_id = u.id""")
def _(d):
    return search.upload_intake_view(d.uploads, d.blobs, d.intake_profiles).select(
        "id", "status", "sha256", "blob_state", "input_category", "detected_format",
        "validation_status",
    )


NODE_VIEW = """SELECT n.id, n.parent_id, n.logical_path, p.logical_path AS parent_path,
       s.logical_path AS source_path, s.format AS source_format,
       EXISTS (SELECT 1 FROM file_nodes c WHERE c.task_id = n.task_id AND c.parent_id = n.id)
         AS has_children
FROM file_nodes n
LEFT JOIN file_nodes p ON p.task_id = n.task_id AND p.id = n.parent_id
LEFT JOIN file_nodes s ON s.task_id = n.task_id AND s.id = n.source_container_id"""
NODE_COLUMNS = [
    "id", "parent_id", "logical_path", "parent_path", "source_path", "source_format",
    "has_children",
]


@query("file_node_view", NODE_VIEW)
def _(d):
    return search.file_node_view(d.file_nodes).select(*NODE_COLUMNS)


@query("tree_children", f"""
SELECT * FROM ({NODE_VIEW}) WHERE parent_id = 103 AND id > 1005 ORDER BY id LIMIT 51""")
def _(d):
    view = search.file_node_view(d.file_nodes)
    return search.tree_children(view, 103, 50, 1005).select(*NODE_COLUMNS)


@query("tree_roots", f"""
SELECT * FROM ({NODE_VIEW}) WHERE parent_id IS NULL AND id > 0 ORDER BY id LIMIT 101""")
def _(d):
    return search.tree_children(search.file_node_view(d.file_nodes), None, 100).select(
        *NODE_COLUMNS
    )


@query("source_archive_items", """
SELECT r.id, r.status, p.canonical_storage_key, p.canonical_size_bytes
FROM decompile_results r LEFT JOIN source_projects p
  ON p.task_id = r.task_id AND p.id = r.analyzer_run_id AND p.deleted_at IS NULL
WHERE r.deleted_at IS NULL""")
def _(d):
    return search.source_archive_items(d.decompile_results, d.source_projects).select(
        "id", "status", "canonical_storage_key", "canonical_size_bytes"
    )


@query("image_structures", """
SELECT id, format, CASE format
  WHEN 'ext4' THEN concat('{"block_size":', json_extract(metadata_json, '$.block_size'),
                          ',"blocks":', json_extract(metadata_json, '$.blocks'), '}')
  WHEN 'squashfs' THEN concat('{"block_size":', json_extract(metadata_json, '$.block_size'),
                              ',"version":', json_extract(metadata_json, '$.version'), '}')
  ELSE concat('{"partition_table":', json_extract(metadata_json, '$.partition_table'),
              ',"sector_size":', json_extract(metadata_json, '$.sector_size'), '}')
  END AS structure_text
FROM file_nodes WHERE node_type = 'file' AND format IN ('ext4', 'squashfs', 'mbr-img')
  AND metadata_json IS NOT NULL AND json_type(metadata_json) = 'OBJECT'""")
def _(d):
    return search.image_structures(d.file_nodes).select(
        "id", "format", F.col("structure").alias("structure_text")
    )


@query("keyset_page_desc", """
SELECT id, created_at FROM tasks
WHERE created_at < TIMESTAMP '1998-01-01' OR (created_at = TIMESTAMP '1998-01-01' AND id < 500)
ORDER BY created_at DESC, id DESC LIMIT 51""")
def _(d):
    return search.page_newest_first(
        d.tasks.select("id", "created_at"), 50, ("1998-01-01 00:00:00", 500)
    )


@query("keyset_page_asc", """
SELECT id, created_at FROM tasks
WHERE created_at > TIMESTAMP '1998-01-01' OR (created_at = TIMESTAMP '1998-01-01' AND id > 500)
ORDER BY created_at, id LIMIT 51""")
def _(d):
    return search.page_oldest_first(
        d.tasks.select("id", "created_at"), 50, ("1998-01-01 00:00:00", 500)
    )


@query("keyset_page_by_id", """
SELECT id, severity FROM vulnerability_findings WHERE id > '300' ORDER BY id LIMIT 101""")
def _(d):
    return search.page_by_id(d.vulnerability_findings.select("id", "severity"), 100, "300")


@query("oldest_first", f"""
SELECT id, sample_expires_at FROM tasks WHERE sample_expires_at <= TIMESTAMP '{ORDERS_AS_OF}'
ORDER BY sample_expires_at, id LIMIT 100""")
def _(d):
    expired = d.tasks.filter(F.col("sample_expires_at") <= predicates.instant(ORDERS_AS_OF))
    return search.oldest(expired.select("id", "sample_expires_at"), "sample_expires_at", 100)


@query("finding_order", """
SELECT id, logical_path, start_line, start_column, rule_id FROM rule_findings
ORDER BY logical_path, start_line, start_column, rule_id""")
def _(d):
    # default string order is unsigned UTF-8 byte order
    return d.rule_findings.select(
        "id", "logical_path", "start_line", "start_column", "rule_id"
    ).orderBy("logical_path", "start_line", "start_column", "rule_id")


@query("binary_symbol_order", """
SELECT id, symbol_key FROM decompile_results WHERE deleted_at IS NULL
ORDER BY encode(symbol_key), id""")
def _(d):
    live = d.decompile_results.filter("deleted_at IS NULL")
    return live.select("id", "symbol_key").orderBy("symbol_key", "id")


@query("redacted_metadata", """
SELECT a.id, replace(fullkey, '"', '') AS path,
       CASE WHEN t.type = 'VARCHAR' THEN json_extract_string(t.value, '$')
            ELSE CAST(t.value AS VARCHAR) END AS shown_value
FROM audit_logs a, json_tree(a.metadata_json) t
WHERE t.type NOT IN ('OBJECT', 'ARRAY')
  AND NOT regexp_matches(fullkey, '(password|token|secret|authorization|cookie|session_id)')""")
def _(d):
    return search.redacted_metadata(d.audit_logs)


@query("source_fragments", """
SELECT doc_id AS project_id, part AS result_id,
       lower(substr(hex(encode(text)), part * 400 + 1, 440)) AS fragment_hex
FROM (SELECT doc_id, text, unnest(range(0, (strlen(text) + 199) // 200)) AS part FROM documents)""")
def _(d):
    # functions derived from the texts: 220 bytes each, one every 200 bytes to the end
    sources = d.documents.select(F.col("doc_id").alias("project_id"), F.col("text").cast("binary").alias("content"))
    size = F.octet_length("text")
    functions = d.documents.where(size > 0).select(
        F.col("doc_id").alias("project_id"),
        F.explode(F.sequence(F.lit(0), F.floor((size - 1) / 200).cast("int"))).alias("result_id"),
    ).select("project_id", "result_id", (F.col("result_id") * 200).alias("offset_bytes"), F.lit(220).alias("length_bytes"))
    return search.source_fragments(functions, sources).select(
        "project_id", "result_id", F.lower(F.hex("fragment")).alias("fragment_hex")
    )


@query("source_line_slices", """
SELECT doc_id AS project_id, part AS result_id,
       array_to_string(lines[part * 2 + 1:part * 2 + 3], chr(10)) AS fragment
FROM (SELECT doc_id, lines, unnest(range(0, (len(lines) + 1) // 2)) AS part
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
def _(d):
    # functions derived from the texts: three lines each, one every two lines to the end
    sources = d.documents.select(F.col("doc_id").alias("project_id"), "text")
    last = F.floor((F.size(F.split("text", "\n")) - 1) / 2).cast("int")
    functions = d.documents.select(
        F.col("doc_id").alias("project_id"), F.explode(F.sequence(F.lit(0), last)).alias("result_id")
    ).select(
        "project_id", "result_id", (F.col("result_id") * 2 + 1).alias("start_line"),
        (F.col("result_id") * 2 + 3).alias("end_line"),
    )
    return search.source_line_slices(functions, sources)
