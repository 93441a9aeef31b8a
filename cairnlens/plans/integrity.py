"""Queries: retention, orphans, runs, projects, data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlens.functions.predicates import instant
from cairnlens.operators import quality, retention, runs
from cairnlens.plans.registry import query

AS_OF = "1999-06-15 00:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"


# --- fixed values: states that keep a task, its sample or an upload -----------------
FINISHED_TASKS = "('SUCCEEDED', 'PARTIAL_SUCCEEDED', 'FAILED', 'CANCELLED')"
RUNNING_JOBS = "('leased', 'running', 'cancel_requested')"
OPEN_JOBS = "('queued', 'leased', 'running', 'cancel_requested')"
OPEN_REPORTS = "('queued', 'generating')"
OPEN_WORK = "('queued', 'running')"
OPEN_ENTRIES = "('eligible', 'failed')"
OPEN_DELETIONS = "('pending', 'cancelling', 'deleting', 'failed')"
# --- end of fixed values

SETTLED = f"status = 'completed' OR status = 'cleaning' AND lease_until > {NOW}"


@query("expired_samples", f"""
WITH busy AS (
  SELECT task_id FROM jobs WHERE status IN {RUNNING_JOBS}
  UNION SELECT task_id FROM jobs WHERE status = 'queued' AND kind <> 'decompile'
  UNION SELECT task_id FROM reports WHERE status IN {OPEN_REPORTS}
  UNION SELECT task_id FROM decompile_results WHERE status IN {OPEN_WORK}
  UNION SELECT task_id FROM retention_operations WHERE {SETTLED}
), due AS (
  SELECT id FROM tasks WHERE status IN {FINISHED_TASKS}
  INTERSECT SELECT id FROM tasks WHERE sample_deleted_at IS NULL AND deleted_at IS NULL
  INTERSECT SELECT id FROM tasks WHERE sample_expires_at <= {NOW}
  EXCEPT SELECT task_id FROM busy
)
SELECT id, sample_expires_at FROM due JOIN tasks USING (id)""")
def _(d):
    return retention.expired_samples(
        d.tasks, d.jobs, d.reports, d.decompile_results, d.retention_operations, AS_OF
    ).select("id", "sample_expires_at")


@query("ready_for_deletion", f"""
WITH busy AS (
  SELECT task_id FROM jobs WHERE status IN {OPEN_JOBS}
  UNION SELECT jobs.task_id FROM jobs SEMI JOIN job_slots ON job_slots.job_id = jobs.id
  UNION SELECT task_id FROM reports WHERE status IN {OPEN_REPORTS}
  UNION SELECT task_id FROM project_deletions WHERE status IN {OPEN_DELETIONS}
  UNION SELECT task_id FROM deletion_operations WHERE {SETTLED}
), free AS (
  SELECT id FROM tasks WHERE deleted_at IS NULL AND status = 'DELETING' EXCEPT SELECT task_id FROM busy
)
SELECT id, updated_at FROM tasks SEMI JOIN free USING (id)""")
def _(d):
    return retention.ready_for_deletion(
        d.tasks, d.jobs, d.job_slots, d.reports, d.project_deletions, d.deletion_operations, AS_OF
    ).select("id", "updated_at")


# Completed uploads with what their intake found; usable ones can still be worked on.
PROFILE = """profile AS (
  SELECT u.id, p.source_kind, p.input_category, p.source_parent_upload_id, p.source_entry_path,
         p.source_archive_name, p.archive_import_id, p.detected_format, u.declared_size_bytes,
         u.actual_sha256, u.blob_id, p.validation_status = 'valid' AS valid,
         p.validation_status = 'valid' AND p.source_kind = 'direct' AND b.state = 'available'
           AND p.detected_format IS NOT NULL AND p.detected_category = p.input_category AS usable
  FROM uploads u JOIN intake_profiles p ON p.upload_id = u.id LEFT JOIN blobs b ON b.id = u.blob_id
  WHERE u.status = 'completed'
)"""


@query("uploads_without_task", f"""
WITH {PROFILE}, open AS (
  SELECT id FROM profile WHERE usable AND input_category <> 'archive' EXCEPT SELECT upload_id FROM tasks
)
SELECT id, input_category, detected_format FROM open JOIN profile USING (id)
WHERE input_category IN ('binary', 'container')""")
def _(d):
    return retention.unclaimed_uploads(d.uploads, d.intake_profiles, d.blobs, d.tasks).select(
        "id", "input_category", "detected_format"
    )


@query("archives_without_import", f"""
WITH {PROFILE}
SELECT id, detected_format, actual_sha256 FROM profile
WHERE usable AND input_category = 'archive' AND archive_import_id IS NULL AND actual_sha256 IS NOT NULL""")
def _(d):
    return retention.archives_without_import(d.uploads, d.intake_profiles, d.blobs).select(
        "id", "detected_format", "actual_sha256"
    )


@query("expired_uploads", f"""
WITH {PROFILE}, open_entry AS (
  SELECT e.*, a.upload_id AS parent_id, parent.display_name AS parent_name
  FROM archive_import_entries e LEFT JOIN archive_imports a ON a.id = e.archive_import_id
  LEFT JOIN uploads parent ON parent.id = a.upload_id
  WHERE e.status IN {OPEN_ENTRIES}
), running AS (
  SELECT id AS archive_import_id, upload_id FROM archive_imports
  WHERE status IN {OPEN_WORK}
), kept AS (
  (SELECT id FROM profile WHERE usable AND input_category IN ('binary', 'container')
   EXCEPT SELECT upload_id FROM tasks)
  UNION SELECT id FROM profile WHERE usable AND input_category = 'archive' AND archive_import_id IS NULL
  UNION SELECT p.id FROM profile p JOIN running r
        ON r.archive_import_id = p.archive_import_id AND r.upload_id = p.id
        WHERE p.usable AND p.input_category = 'archive'
  UNION SELECT p.id FROM profile p JOIN open_entry e ON e.derived_upload_id = p.id
        WHERE p.source_kind = 'archive_entry'
  UNION SELECT p.id FROM profile p JOIN open_entry e
        ON (e.parent_id, e.parent_name, e.logical_path, e.detected_category, e.detected_format,
            e.size_bytes, e.sha256, e.blob_id)
         = (p.source_parent_upload_id, p.source_archive_name, p.source_entry_path, p.input_category,
            p.detected_format, p.declared_size_bytes, p.actual_sha256, p.blob_id)
        WHERE p.valid AND p.source_kind = 'archive_entry' AND e.derived_upload_id IS NULL
), unclean AS (
  SELECT id FROM uploads WHERE status <> 'expired' UNION
  SELECT id FROM uploads WHERE blob_id IS NOT NULL UNION SELECT upload_id FROM upload_parts
), gone AS (
  SELECT id FROM uploads WHERE expires_at <= {NOW} INTERSECT SELECT id FROM unclean
  EXCEPT SELECT id FROM kept
)
SELECT id, expires_at FROM uploads SEMI JOIN gone USING (id)""")
def _(d):
    return retention.expired_uploads(
        d.uploads, d.upload_parts, d.intake_profiles, d.blobs, d.tasks, d.archive_imports,
        d.archive_import_entries, AS_OF,
    ).select("id", "expires_at")


@query("pending_part_cleanup", """
SELECT id, updated_at FROM uploads WHERE parts_cleaned_at IS NULL
  AND status IN ('completed', 'failed', 'expired', 'cancelled') ORDER BY updated_at, id LIMIT 100""")
def _(d):
    return retention.pending_part_cleanup(d.uploads, 100).select("id", "updated_at")


@query("orphan_derived_uploads", """
SELECT DISTINCT u.id, u.created_by FROM archive_imports a
JOIN intake_profiles p ON p.source_parent_upload_id = a.upload_id
     AND p.source_kind = 'archive_entry'
JOIN uploads u ON u.id = p.upload_id
LEFT JOIN archive_import_entries e ON e.archive_import_id = a.id
     AND e.logical_path = p.source_entry_path
LEFT JOIN tasks t ON t.upload_id = u.id
WHERE t.id IS NULL AND (e.id IS NULL OR e.status <> 'created')
  AND NOT (u.status = 'cancelled' OR (u.status = 'expired' AND u.blob_id IS NULL))""")
def _(d):
    return retention.orphan_derived_uploads(
        d.archive_imports, d.intake_profiles, d.uploads, d.archive_import_entries, d.tasks
    )


@query("entry_provenance_match", """
SELECT entry_id, count(*) AS candidate_count,
       count(DISTINCT CASE WHEN task_id IS NOT NULL THEN (task_id, upload_id) END) AS task_count,
       min(CASE WHEN task_id IS NOT NULL THEN upload_id END) AS upload_id, min(task_id) AS task_id,
       count(DISTINCT CASE WHEN task_id IS NOT NULL THEN (task_id, upload_id) END) > 1
         OR COALESCE(linked_upload <> min(CASE WHEN task_id IS NOT NULL THEN upload_id END), false)
         OR COALESCE(linked_task <> min(task_id), false) AS conflict
FROM (SELECT e.id AS entry_id, u.id AS upload_id, t.id AS task_id,
             e.derived_upload_id AS linked_upload, e.task_id AS linked_task
      FROM archive_import_entries e JOIN archive_imports a ON a.id = e.archive_import_id
      JOIN uploads pa ON pa.id = a.upload_id
      JOIN intake_profiles p ON p.source_kind = 'archive_entry'
        AND p.source_parent_upload_id = a.upload_id AND p.source_archive_name = pa.display_name
        AND p.source_entry_path = e.logical_path AND p.validation_status = 'valid'
        AND p.input_category = e.detected_category AND p.detected_category = e.detected_category
        AND p.detected_format = e.detected_format
      JOIN uploads u ON u.id = p.upload_id AND u.created_by % 2 = pa.created_by % 2
        AND u.declared_size_bytes = e.size_bytes AND u.actual_sha256 = e.sha256
        AND u.blob_id = e.blob_id
      LEFT JOIN tasks t ON t.upload_id = u.id)
GROUP BY entry_id, linked_upload, linked_task""")
def _(d):
    # two owners, so that parents and derived uploads can share one
    uploads = d.uploads.withColumn("created_by", F.col("created_by") % 2)
    return retention.entry_provenance_match(
        d.archive_import_entries, d.archive_imports, uploads, d.intake_profiles, d.tasks
    )


REFERENCES = """
(SELECT blob_id FROM uploads UNION ALL
 SELECT blob_id FROM tasks WHERE sample_deleted_at IS NULL AND deleted_at IS NULL UNION ALL
 SELECT blob_id FROM blob_refs UNION ALL
 SELECT source_blob_id FROM archive_imports WHERE source_blob_released_at IS NULL UNION ALL
 SELECT blob_id FROM archive_import_entries WHERE blob_released_at IS NULL)"""


def _references(d) -> DataFrame:
    return retention.blob_references(
        d.uploads, d.tasks, d.blob_refs, d.archive_imports, d.archive_import_entries
    )


@query("blob_reference_counts", f"""
WITH uses AS (
  SELECT id, 0 AS one FROM blobs UNION ALL SELECT blob_id, 1 FROM {REFERENCES}
), counted AS (SELECT id, sum(one)::BIGINT AS actual_count FROM uses GROUP BY id),
moves(state, used, next_state, waits) AS (
  VALUES ('deleting', true, 'available', false), ('available', false, 'deleting', false),
         ('staging', false, 'deleting', true)
)
SELECT b.id, b.state, b.reference_count, c.actual_count,
       coalesce(m.next_state, b.state) AS current_state,
       (b.reference_count, b.state) <> (c.actual_count, coalesce(m.next_state, b.state)) AS drifted
FROM blobs b JOIN counted c USING (id)
LEFT JOIN moves m ON m.state = b.state AND m.used = (c.actual_count > 0)
     AND (NOT m.waits OR b.created_at <= {NOW})""")
def _(d):
    return retention.blob_reference_counts(d.blobs, _references(d), AS_OF)


@query("blob_orphans", f"""
SELECT i.storage_key, i.size_bytes FROM store_inventory i WHERE i.modified_at <= {NOW}
  AND NOT EXISTS (SELECT 1 FROM blobs b WHERE b.storage_key = i.storage_key
        AND (b.state <> 'deleted' OR b.id IN (SELECT blob_id FROM {REFERENCES}
             WHERE blob_id IS NOT NULL)))""")
def _(d):
    return retention.blob_orphans(
        d.store_inventory, d.blobs, _references(d), AS_OF
    ).select("storage_key", "size_bytes")


@query("stored_file_orphans", """
SELECT f.kind, f.storage_key FROM stored_files f
WHERE NOT CASE f.kind
  WHEN 'report' THEN f.storage_key IN (SELECT storage_key FROM reports
       WHERE deleted_at IS NULL AND storage_key IS NOT NULL)
  WHEN 'report_staging' THEN f.storage_key IN (SELECT concat('staging/', task_id, '/', id)
       FROM reports WHERE deleted_at IS NULL AND snapshot_state = 'staged'
         AND status IN ('queued', 'generating'))
  WHEN 'artifact' THEN f.storage_key IN (SELECT storage_key FROM artifacts
       WHERE deleted_at IS NULL AND state IN ('staged', 'published', 'deleting'))
  ELSE f.storage_key IN (SELECT storage_key FROM decompile_results
       WHERE deleted_at IS NULL AND storage_key IS NOT NULL) END""")
def _(d):
    return retention.stored_file_orphans(
        d.stored_files, d.reports, d.artifacts, d.decompile_results
    ).select("kind", "storage_key")


@query("source_project_orphans", """
SELECT f.project_id, f.storage_key FROM project_folders f
WHERE NOT EXISTS (SELECT 1 FROM source_projects p WHERE p.id = f.project_id
  AND p.layout_version = 'project-v1' AND p.root_storage_key = f.storage_key
  AND (p.deleted_at IS NULL
       OR EXISTS (SELECT 1 FROM project_deletions o WHERE o.active_project_id = p.id)))""")
def _(d):
    return retention.source_project_orphans(
        d.project_folders, d.source_projects, d.project_deletions
    )


PUBLISHED = """
SELECT r.*, a.analyzer_name, a.analyzer_version FROM rule_runs r
JOIN source_projects p ON p.task_id = r.task_id AND p.id = r.source_project_id
JOIN rule_run_analyzers a ON a.task_id = r.task_id AND a.id = r.id
WHERE r.status IN ('succeeded', 'partial') AND r.completed_at IS NOT NULL
  AND r.deletion_started_at IS NULL AND p.deleted_at IS NULL AND p.storage_deleted_at IS NULL"""
LATEST = f"""SELECT * FROM ({PUBLISHED}) QUALIFY row_number() OVER (
  PARTITION BY task_id, source_project_id, language ORDER BY completed_at DESC, id DESC) = 1"""


def _published(d):
    return runs.project_runs(d.rule_runs, d.source_projects, d.rule_run_analyzers)


@query("project_runs", f"""
SELECT id, source_project_id, language, analyzer_version FROM ({PUBLISHED})""")
def _(d):
    return _published(d).select("id", "source_project_id", "language", "analyzer_version")


@query("latest_run_per_project", f"SELECT id, source_project_id, language, completed_at FROM ({LATEST})")
def _(d):
    return runs.latest_run_per_project(_published(d)).select(
        "id", "source_project_id", "language", "completed_at"
    )


@query("findings_latest_run", f"""
SELECT f.id, f.run_id, l.source_project_id, l.language, f.severity
FROM rule_findings f JOIN ({LATEST}) l ON l.id = f.run_id""")
def _(d):
    latest = runs.latest_run_per_project(_published(d))
    return runs.findings_latest_run(d.rule_findings, latest).select(
        "id", "run_id", "source_project_id", "language", "severity"
    )


@query("report_dependencies", f"""
SELECT r.id AS report_id, r.id AS run_id, COALESCE(
         p.completed_at = r.completed_at + CASE WHEN r.id % 7 = 0 THEN INTERVAL 1 SECOND
                                           ELSE INTERVAL 0 SECOND END
         AND p.source_sha256 = r.source_sha256, false) AS holds
FROM rule_runs r LEFT JOIN ({PUBLISHED}) p ON p.id = r.id
     AND p.source_project_id = r.source_project_id
WHERE r.completed_at IS NOT NULL""")
def _(d):
    frozen = d.rule_runs.filter("completed_at IS NOT NULL").select(
        F.col("id").alias("report_id"), F.col("id").alias("run_id"), "source_project_id",
        F.expr("completed_at + CASE WHEN id % 7 = 0 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END")
        .alias("completed_at"),
        "source_sha256",
    )
    return runs.report_dependencies(frozen, _published(d))


ACTIVE_PROJECTS = """
SELECT DISTINCT task_id, id FROM (
  SELECT r.task_id, r.source_project_id AS id, r.status AS run_status, j.status AS job_status
  FROM rule_runs r JOIN rule_jobs j ON j.task_id = r.task_id AND j.id = r.job_id
  WHERE r.language = 'c'
  UNION ALL
  SELECT r.task_id, r.source_project_id, r.status, j.status
  FROM rule_runs r JOIN rule_jobs j ON j.task_id = r.task_id AND j.id = r.job_id
  WHERE r.language = 'java')
WHERE job_status IN ('queued', 'leased', 'running', 'cancel_requested')
   OR run_status IN ('queued', 'running', 'cancel_requested')"""


@query("active_runs_union", ACTIVE_PROJECTS)
def _(d):
    parts = [d.rule_runs.filter(F.col("language") == name) for name in ("c", "java")]
    return runs.active_project_analysis(parts, d.rule_jobs)


@query("active_project_analysis", f"""
SELECT p.id, p.status FROM source_projects p
WHERE (p.task_id, p.id) IN (SELECT (task_id, id) FROM ({ACTIVE_PROJECTS}))""")
def _(d):
    parts = [d.rule_runs.filter(F.col("language") == name) for name in ("c", "java")]
    active = runs.active_project_analysis(parts, d.rule_jobs)
    return d.source_projects.join(active, ["task_id", "id"], "left_semi").select("id", "status")


@query("rule_severity_rollup", """
SELECT run_id, count(*) AS finding_count, count(*) FILTER (severity = 'LOW') AS low_count,
       count(*) FILTER (severity = 'MEDIUM') AS medium_count,
       count(*) FILTER (severity = 'HIGH') AS high_count,
       count(*) FILTER (severity = 'CRITICAL') AS critical_count
FROM rule_findings GROUP BY run_id""")
def _(d):
    return runs.rule_severity_rollup(d.rule_findings)


@query("distinct_findings", """
SELECT id, logical_path, rule_id, start_line, start_column FROM rule_findings
QUALIFY row_number() OVER (PARTITION BY logical_path, rule_id, start_line, start_column
                           ORDER BY id) = 1""")
def _(d):
    return runs.distinct_findings(d.rule_findings, "logical_path").select(
        "id", "logical_path", "rule_id", "start_line", "start_column"
    )


COVERAGE = """
SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag <> 'R') AS parsed,
       count(*) FILTER (l_returnflag = 'R') AS failed,
       count(*) FILTER (l_returnflag = 'A') AS analyzed,
       count(*) FILTER (l_linenumber = 7) AS recovered, max(l_quantity) > 49 AS findings_truncated,
       max(l_suppkey) % 20 = 0 AS diagnostics_truncated,
       CASE WHEN l_orderkey % 5 = 0 THEN 'partial' ELSE 'complete' END AS project_status
FROM lineitem GROUP BY l_orderkey"""


def _coverage(d):
    return d.lineitem.groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count_if(F.col("l_returnflag") != "R").alias("parsed"),
        F.count_if(F.col("l_returnflag") == "R").alias("failed"),
        F.count_if(F.col("l_returnflag") == "A").alias("analyzed"),
        F.count_if(F.col("l_linenumber") == 7).alias("recovered"),
        (F.max("l_quantity") > 49).alias("findings_truncated"),
        (F.max("l_suppkey") % 20 == 0).alias("diagnostics_truncated"),
    ).withColumn("project_status", F.when(F.col("run_id") % 5 == 0, "partial").otherwise("complete"))


@query("analysis_status", f"""
SELECT run_id, CASE WHEN parsed = 0 AND failed > 0 THEN 'failed'
    WHEN failed > 0 OR findings_truncated OR diagnostics_truncated OR project_status = 'partial'
    THEN 'partial' ELSE 'succeeded' END AS c_status,
  CASE WHEN analyzed = 0 THEN 'failed'
    WHEN project_status = 'partial' OR recovered > 0 OR failed > 0 OR analyzed < parsed
         OR findings_truncated OR diagnostics_truncated
    THEN 'partial' ELSE 'complete' END AS java_status
FROM ({COVERAGE})""")
def _(d):
    both = runs.analysis_status(_coverage(d), "c").withColumnRenamed("analysis_status", "c_status")
    return runs.analysis_status(both, "java").select(
        "run_id", "c_status", F.col("analysis_status").alias("java_status")
    )


RULES = "(VALUES ('cwe-242-gets','CWE-242'), ('cwe-120-bounds','CWE-120'), " \
    "('cwe-134-format','CWE-134'), ('cwe-78-command','CWE-78'), ('cwe-377-temp-file','CWE-377'), " \
    "('cwe-327-328-weak-crypto','CWE-327'), ('cwe-327-328-weak-crypto','CWE-328')) AS k(r, c)"


@query("finding_rule_cwe", f"""
SELECT id, rule_id, cwe FROM rule_findings
WHERE NOT EXISTS (SELECT 1 FROM {RULES} WHERE r = rule_id AND c = cwe)""")
def _(d):
    return runs.finding_rule_cwe(d.rule_findings).select("id", "rule_id", "cwe")


@query("finding_in_function", """
SELECT h.hit_id, f.result_id, h.start_line FROM project_hits h
JOIN project_functions f ON f.project_id = h.project_id
 AND h.start_line >= f.start_line AND h.end_line <= f.end_line""")
def _(d):
    return runs.finding_in_function(d.project_hits, d.project_functions).select(
        "hit_id", "result_id", "start_line"
    )


LIMITS = {"json_bytes": 4096, "results": 100, "total_bytes": 100000, "total_json_bytes": 100000}
FINE = """(s.deleted_at IS NULL AND s.file_node_id = r.file_node_id
  AND s.engine_name = r.analyzer_name AND s.engine_version = r.analyzer_version
  AND s.status = json_extract_string(r.parameters_json, '$.result_status')
  AND s.completed_at IS NOT NULL AND s.storage_key IS NOT NULL AND s.content_sha256 IS NOT NULL
  AND s.size_bytes > 0 AND octet_length(s.diagnostics_json) BETWEEN 1 AND 4096)"""
COMPLETENESS = f"""
SELECT r.task_id, r.id AS analyzer_run_id, count(*) AS result_count,
       sum(s.size_bytes)::BIGINT AS total_bytes,
       sum(octet_length(s.diagnostics_json))::BIGINT AS total_json_bytes,
       bool_and({FINE}) AS consistent,
       bool_and({FINE}) AND count(*) = CAST(json_extract_string(r.parameters_json,
         '$.result_count') AS BIGINT) AND sum(s.size_bytes) BETWEEN 1 AND 100000 AS complete
FROM cache_runs r JOIN cache_results s ON s.task_id = r.task_id AND s.analyzer_run_id = r.id
GROUP BY r.task_id, r.id, r.parameters_json"""


@query("run_completeness", COMPLETENESS)
def _(d):
    return runs.run_completeness(d.cache_runs, d.cache_results, LIMITS)


USABLE = """SELECT id FROM tasks WHERE status IN ('SUCCEEDED', 'PARTIAL_SUCCEEDED', 'FAILED',
  'CANCELLED') AND sample_deleted_at IS NULL AND deleted_at IS NULL
  AND sample_expires_at > TIMESTAMP '1996-01-01'"""
SAME = " AND ".join(
    f"json_extract_string(s.parameters_json, '$.{field}') = "
    f"json_extract_string(c.parameters_json, '$.{field}')"
    for field in runs.CACHE_FIELDS
)


@query("cache_candidates", f"""
SELECT id, source_run_id, source_task_id FROM (
  SELECT c.id, s.id AS source_run_id, s.task_id AS source_task_id,
         row_number() OVER (PARTITION BY c.id ORDER BY s.completed_at DESC, s.id DESC) AS k
  FROM cache_runs c JOIN cache_runs s ON s.cache_identity = c.cache_identity
       AND s.analyzer_name = c.analyzer_name AND s.analyzer_version = c.analyzer_version
       AND s.id <> c.id AND {SAME}
  JOIN ({COMPLETENESS}) q ON q.analyzer_run_id = s.id AND q.task_id = s.task_id AND q.complete
  WHERE c.status = 'running' AND s.status = 'succeeded' AND s.completed_at IS NOT NULL
    AND json_extract_string(s.parameters_json, '$.result_status') IN ('complete', 'bytecode_only')
    AND c.task_id IN ({USABLE}) AND s.task_id IN ({USABLE}))
WHERE k = 1""")
def _(d):
    return runs.cache_candidates(
        d.cache_runs, d.tasks, d.cache_results, instant("1996-01-01 00:00:00"), LIMITS
    )


STORED = """(s.storage_key IS NOT NULL AND s.content_sha256 IS NOT NULL AND s.size_bytes IS NOT NULL
  AND s.status IN ('complete', 'partial', 'bytecode_only'))"""


@query("project_rollup", f"""
WITH results AS (
  SELECT *, {STORED} AS held FROM decompile_results s WHERE deleted_at IS NULL
), gathered AS (
  SELECT task_id, analyzer_run_id AS id, list(DISTINCT language) FILTER (held AND language IS NOT NULL) AS languages,
         list(DISTINCT coalesce(status, '')) AS states, count(DISTINCT storage_key) FILTER (held) AS source_file_count,
         count(*) AS symbol_count, coalesce(sum(size_bytes) FILTER (held), 0)::BIGINT AS source_size_bytes,
         min(created_at) AS first_created, max(completed_at) AS last_completed
  FROM results GROUP BY ALL HAVING count(storage_key) FILTER (held) > 0
)
SELECT r.id,
  if(r.analyzer_name = 'ghidra', 'ghidra-pseudoc', coalesce(
     list_filter(['java', 'kotlin', 'python'], lambda l: list_contains(g.languages, l))[1], 'bytecode')) AS source_kind,
  if(r.analyzer_name = 'ghidra', 'c', if(len(g.languages) = 1, g.languages[1], 'mixed')) AS language,
  if(r.status <> 'partial' AND len(g.states) = 1 AND list_contains(['complete', 'bytecode_only'], g.states[1]),
     g.states[1], 'partial') AS status,
  g.source_file_count, g.symbol_count, g.source_size_bytes,
  least(r.created_at, g.first_created) AS created_at, coalesce(r.completed_at, g.last_completed) AS completed_at
FROM analyzer_runs r JOIN gathered g USING (id, task_id) WHERE r.file_node_id IS NOT NULL""")
def _(d):
    return runs.project_rollup(d.analyzer_runs, d.decompile_results)


def _impact(language, table):
    return f"""(SELECT count(*) FROM rule_runs r {table} WHERE r.task_id = p.task_id
      AND r.source_project_id = p.id AND r.language = '{language}')"""


@query("deletion_impact", f"""
SELECT p.task_id, p.id AS source_project_id, {_impact('c', '')} AS c_runs,
  {_impact('c', 'JOIN rule_findings f ON f.run_id = r.id')} AS c_findings,
  {_impact('java', '')} AS java_runs,
  {_impact('java', 'JOIN rule_findings f ON f.run_id = r.id')} AS java_findings,
  (SELECT count(*) FROM reports q WHERE q.task_id = p.task_id) AS reports,
  (SELECT count(*) FROM reports q WHERE q.task_id = p.task_id AND storage_key IS NOT NULL)
    AS report_files,
  (SELECT count(DISTINCT artifact_id) FROM reports q WHERE q.task_id = p.task_id) AS artifacts,
  (SELECT count(*) FROM decompile_results s WHERE s.task_id = p.task_id
      AND s.analyzer_run_id = p.id) AS results
FROM source_projects p""")
def _(d):
    return runs.deletion_impact(
        d.source_projects, d.rule_runs, d.rule_findings, d.reports, d.decompile_results
    )


@query("current_before_staged", """
SELECT task_id, format, snapshot_state, generation, id FROM reports
WHERE deleted_at IS NULL AND ((snapshot_state = 'current' AND status = 'complete')
  OR (snapshot_state = 'staged' AND status IN ('queued', 'generating')))
ORDER BY task_id, format, snapshot_state <> 'current', generation DESC, id DESC""")
def _(d):
    return runs.current_before_staged(d.reports).select(
        "task_id", "format", "snapshot_state", "generation", "id"
    )


@query("batch_complete", """
SELECT id FROM batches b WHERE status = 'processing' AND NOT EXISTS (
  SELECT 1 FROM batch_items i WHERE i.batch_id = b.id AND outcome IN ('pending', 'processing'))""")
def _(d):
    return runs.batch_complete(d.batches, d.batch_items).select("id")


@query("import_summary", """
SELECT archive_import_id, count(*) AS total, count(*) FILTER (status = 'eligible') AS eligible,
       count(*) FILTER (status = 'skipped') AS skipped,
       count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'failed') AS failed
FROM archive_import_entries GROUP BY archive_import_id""")
def _(d):
    return runs.import_summary(d.archive_import_entries)


@query("import_skip_reasons", """
SELECT archive_import_id, skip_reason, count(*) AS n FROM archive_import_entries
WHERE status = 'skipped' GROUP BY ALL""")
def _(d):
    return runs.import_skip_reasons(d.archive_import_entries)


ENUMS = {
    "jobs": ("kind", "'scan','image','native','bytecode','trivy','report','decompile','c_analysis','java_analysis'"),
    "tasks": ("risk_level", "'UNKNOWN','NONE','LOW','MEDIUM','HIGH','CRITICAL'"),
    "source_projects": ("status", "'complete','partial','bytecode_only'"),
    "file_nodes": ("node_type", "'file','directory','symlink','hardlink','special'"),
}


@query("enum_violations", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS bad_value, count(*) AS row_count "
    f"FROM {t} WHERE {c} NOT IN ({v}) GROUP BY {c}" for t, (c, v) in ENUMS.items()))
def _(d):
    names = ["tasks", "jobs", "blobs", "uploads", "task_events", "file_nodes", "analyzer_runs",
             "decompile_results", "vulnerability_findings", "source_projects"]
    return quality.all_enum_violations({name: getattr(d, name) for name in names})


@query("foreign_key_violations", """
SELECT 'file_nodes.parent_id' AS constraint_name, CAST(n.id AS VARCHAR) AS row_id FROM file_nodes n
WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM file_nodes p WHERE p.id = n.parent_id)
UNION ALL
SELECT 'findings.database_bundle_id', id FROM vulnerability_findings f
WHERE database_bundle_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM database_bundles b WHERE b.id = f.database_bundle_id)
UNION ALL
SELECT 'jobs.task_id', CAST(id AS VARCHAR) FROM jobs j
WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.id = j.task_id)""")
def _(d):
    nodes, found = d.file_nodes, d.vulnerability_findings
    checks = [
        ("file_nodes.parent_id", quality.foreign_key_violations(nodes, "parent_id", nodes)),
        ("findings.database_bundle_id",
         quality.foreign_key_violations(found, "database_bundle_id", d.database_bundles)),
        ("jobs.task_id", quality.foreign_key_violations(d.jobs, "task_id", d.tasks)),
    ]
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("constraint_name"), F.col("id").cast("string").alias("row_id"))
        for name, df in checks
    ])


@query("unique_violations", """
SELECT 'blobs.sha256' AS constraint_name, sha256 AS key_value, count(*) AS row_count
FROM blobs GROUP BY sha256 HAVING count(*) > 1
UNION ALL
SELECT 'tasks.upload_id', CAST(upload_id AS VARCHAR), count(*) FROM tasks
GROUP BY upload_id HAVING count(*) > 1
UNION ALL
SELECT 'task_events', concat(task_id, '/', event_sequence), count(*) FROM task_events
GROUP BY task_id, event_sequence HAVING count(*) > 1""")
def _(d):
    parts = [
        quality.unique_violations(d.blobs, ["sha256"]).select(
            F.lit("blobs.sha256").alias("constraint_name"), F.col("sha256").alias("key_value"),
            "row_count"),
        quality.unique_violations(d.tasks, ["upload_id"]).select(
            F.lit("tasks.upload_id").alias("constraint_name"),
            F.col("upload_id").cast("string").alias("key_value"), "row_count"),
        quality.unique_violations(d.task_events, ["task_id", "event_sequence"]).select(
            F.lit("task_events").alias("constraint_name"),
            F.concat_ws("/", "task_id", "event_sequence").alias("key_value"), "row_count"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("source_range_violations", """
SELECT id, source_length_bytes, source_start_line, source_end_line FROM decompile_results
WHERE NOT ((source_offset_bytes IS NULL AND source_length_bytes IS NULL
            AND source_start_line IS NULL AND source_end_line IS NULL)
  OR (source_offset_bytes IS NOT NULL AND source_length_bytes IS NOT NULL
      AND source_length_bytes > 0 AND source_start_line IS NOT NULL AND source_start_line > 0
      AND source_end_line IS NOT NULL AND source_end_line >= source_start_line))""")
def _(d):
    return quality.source_range_violations(d.decompile_results).select(
        "id", "source_length_bytes", "source_start_line", "source_end_line"
    )


@query("part_completeness", """
SELECT u.id, count(p.upload_id) AS part_count,
       COALESCE(min(p.part_number) = 1 AND max(p.part_number) = count(*)
                AND count(DISTINCT p.part_number) = count(*), false) AS contiguous,
       COALESCE(sum(p.size_bytes) = u.declared_size_bytes, false) AS size_matches,
       COALESCE(bool_and(p.sha256 = p.actual_sha256), false) AS digests_match
FROM part_uploads u LEFT JOIN upload_parts p ON p.upload_id = u.id
GROUP BY u.id, u.declared_size_bytes""")
def _(d):
    return quality.part_completeness(d.part_uploads, d.upload_parts)


@query("manifest_compare", """
SELECT COALESCE(a.bundle_id, b.bundle_id) AS bundle_id, COALESCE(a.path, b.path) AS path,
       CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'unexpected'
            WHEN a.size_bytes <> b.size_bytes THEN 'size_mismatch' ELSE 'digest_mismatch' END
         AS problem
FROM manifest_declared a FULL JOIN manifest_actual b
  ON a.bundle_id = b.bundle_id AND a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.size_bytes <> b.size_bytes OR a.sha256 <> b.sha256""")
def _(d):
    return quality.manifest_compare(d.manifest_declared, d.manifest_actual).select(
        "bundle_id", "path", "problem"
    )


@query("finding_violations", f"""
SELECT id AS row_id, 'severity' AS violation FROM rule_findings
WHERE severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')
UNION ALL SELECT id, 'message' FROM rule_findings WHERE message = ''
UNION ALL SELECT id, 'line_order' FROM rule_findings WHERE end_line < start_line
UNION ALL SELECT id, 'column_order' FROM rule_findings
WHERE end_line = start_line AND end_column < start_column
UNION ALL SELECT id, 'rule' FROM rule_findings
WHERE NOT EXISTS (SELECT 1 FROM {RULES} WHERE r = rule_id AND c = cwe)""")
def _(d):
    return quality.finding_violations(d.rule_findings)


@query("input_digest", """
WITH entry_lines AS (
  SELECT bundle_id, path, concat(path, chr(0), size_bytes, chr(0), sha256, chr(10)) AS line FROM manifest_declared
)
SELECT bundle_id AS project_id, count(*) AS file_count,
       sha256('files/v1' || chr(10) || array_to_string(list(line ORDER BY path), '')) AS input_sha256
FROM entry_lines GROUP BY bundle_id""")
def _(d):
    files = d.manifest_declared.select(
        F.col("bundle_id").alias("project_id"), F.col("path").alias("logical_path"),
        "size_bytes", "sha256",
    )
    return quality.input_digest(files, "files/v1", ["logical_path", "size_bytes", "sha256"])
