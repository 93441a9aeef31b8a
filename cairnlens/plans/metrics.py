"""Queries: operational metrics and finding summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlens.operators import findings, metrics
from cairnlens.plans.registry import query

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "1999-06-15 00:00:00"

STATUSES = """(VALUES ('UPLOADING'), ('QUEUED'), ('VALIDATING'), ('IDENTIFYING'), ('EXTRACTING'),
  ('INDEXING'), ('SCANNING'), ('REPORTING'), ('SUCCEEDED'), ('PARTIAL_SUCCEEDED'), ('FAILED'),
  ('CANCEL_REQUESTED'), ('CANCELLED'), ('DELETING'), ('DELETED')) AS s(status)"""


@query("severity_summary", """
SELECT task_id, count(*) AS total,
       count(*) FILTER (NULLIF(trim(fixed_version), '') IS NOT NULL) AS fixable,
       count(*) FILTER (severity = 'UNKNOWN') AS unknown, count(*) FILTER (severity = 'LOW') AS low,
       count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'HIGH') AS high,
       count(*) FILTER (severity = 'CRITICAL') AS critical
FROM vulnerability_findings GROUP BY task_id""")
def _(d):
    return findings.severity_summary(d.vulnerability_findings)


@query("task_risk", """
SELECT t.id AS task_id, COALESCE(MAX(CASE f.severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4
         WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END), 0) AS risk_rank,
       CASE COALESCE(MAX(CASE f.severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4
         WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END), 0)
         WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 2 THEN 'LOW'
         WHEN 1 THEN 'UNKNOWN' ELSE 'NONE' END AS risk_level
FROM tasks t LEFT JOIN vulnerability_findings f ON f.task_id = t.id GROUP BY t.id""")
def _(d):
    return findings.task_risk(d.tasks, d.vulnerability_findings)


@query("severity_breakdown", """
SELECT task_id, severity, count(*) AS finding_count,
       sum(CASE WHEN NULLIF(trim(fixed_version), '') IS NULL THEN 0 ELSE 1 END)::BIGINT AS fixable,
       CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3
            WHEN 'LOW' THEN 4 WHEN 'UNKNOWN' THEN 5 ELSE 0 END AS position
FROM vulnerability_findings GROUP BY task_id, severity""")
def _(d):
    return findings.severity_breakdown(d.vulnerability_findings)


@query("severity_rank", """
SELECT severity, CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3
       WHEN 'LOW' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END AS severity_rank, count(*) AS n
FROM rule_findings GROUP BY severity""")
def _(d):
    from cairnlens.functions.predicates import severity_rank

    return (
        d.rule_findings.groupBy("severity")
        .agg(F.count("*").alias("n"))
        .withColumn("severity_rank", severity_rank())
    )


@query("run_publication_check", """
SELECT r.id AS run_id, declared_finding_count, declared_bundle_id, count(f.id) AS stored_count,
       count(f.id) FILTER (f.database_bundle_id = declared_bundle_id) AS matching_count,
       count(f.id) = declared_finding_count
         AND count(f.id) FILTER (f.database_bundle_id = declared_bundle_id) = count(f.id)
         AS complete
FROM analyzer_runs r LEFT JOIN vulnerability_findings f ON f.analyzer_run_id = r.id
GROUP BY r.id, declared_finding_count, declared_bundle_id""")
def _(d):
    return findings.run_publication_check(d.analyzer_runs, d.vulnerability_findings)


@query("findings_with_database", """
SELECT f.id, f.task_id, f.vulnerability_id, f.severity, b.version AS bundle_version,
       b.generated_at AS bundle_generated_at
FROM vulnerability_findings f LEFT JOIN database_bundles b ON b.id = f.database_bundle_id""")
def _(d):
    return findings.findings_with_database(
        d.vulnerability_findings, d.database_bundles
    ).select("id", "task_id", "vulnerability_id", "severity", "bundle_version", "bundle_generated_at")


@query("databases_used", """
SELECT b.id, b.version FROM database_bundles b
WHERE EXISTS (SELECT 1 FROM vulnerability_findings f WHERE f.database_bundle_id = b.id)
   OR EXISTS (SELECT 1 FROM analyzer_runs r WHERE r.analyzer_name = 'ghidra'
              AND CAST(json_extract_string(r.parameters_json, '$.database_bundle.id') AS BIGINT)
                  = b.id)""")
def _(d):
    runs = d.analyzer_runs.filter("analyzer_name = 'ghidra'")
    return findings.databases_used(d.database_bundles, d.vulnerability_findings, runs).select(
        "id", "version"
    )


@query("truncate_per_task", """
SELECT task_id, id, severity, position,
       (SELECT count(*) FROM vulnerability_findings g WHERE g.task_id = q.task_id) > 3 AS truncated
FROM (SELECT task_id, id, severity, row_number() OVER (PARTITION BY task_id ORDER BY
        CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3
             WHEN 'LOW' THEN 4 WHEN 'UNKNOWN' THEN 5 ELSE 0 END, id) AS position
      FROM vulnerability_findings) q WHERE position <= 3""")
def _(d):
    from cairnlens.functions.predicates import severity_position

    rows = d.vulnerability_findings.select("task_id", "id", "severity")
    return findings.truncate_per_task(rows, [severity_position(), F.col("id")], 3)


@query("severity_order", """
SELECT id, severity, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3
       WHEN 'LOW' THEN 4 WHEN 'UNKNOWN' THEN 5 ELSE 0 END AS position
FROM rule_findings ORDER BY position, logical_path, start_line, id""")
def _(d):
    from cairnlens.functions.predicates import severity_position

    rows = findings.ordered_by_severity(d.rule_findings, ["logical_path", "start_line", "id"])
    return rows.select("id", "severity", severity_position().alias("position"))


@query("live_tasks", "SELECT id, status FROM tasks WHERE deleted_at IS NULL")
def _(d):
    return metrics.live_tasks(d.tasks).select("id", "status")


@query("task_counts", f"""
SELECT s.status, count(t.id) AS task_count,
       s.status IN ('VALIDATING', 'IDENTIFYING', 'EXTRACTING', 'INDEXING', 'SCANNING', 'REPORTING',
                    'CANCEL_REQUESTED', 'DELETING') AS is_active, s.status = 'QUEUED' AS is_queued
FROM {STATUSES} LEFT JOIN (SELECT * FROM tasks WHERE deleted_at IS NULL) t ON t.status = s.status
GROUP BY s.status""")
def _(d):
    return metrics.task_counts(d.tasks)


@query("task_totals", """
SELECT count(*) AS total, count(*) FILTER (status IN ('VALIDATING', 'IDENTIFYING', 'EXTRACTING',
         'INDEXING', 'SCANNING', 'REPORTING', 'CANCEL_REQUESTED', 'DELETING')) AS active,
       count(*) FILTER (status = 'QUEUED') AS queued
FROM tasks WHERE deleted_at IS NULL""")
def _(d):
    return metrics.task_totals(d.tasks)


LEASED = f"""j.status IN ('leased', 'running', 'cancel_requested') AND j.lease_owner IS NOT NULL
  AND j.lease_until > TIMESTAMP '{ORDERS_AS_OF}'"""


@query("queue_summary", f"""
SELECT count(*) FILTER (j.status = 'queued') AS depth, count(*) FILTER ({LEASED}) AS leases,
       count(DISTINCT CASE WHEN {LEASED} THEN j.lease_owner END) AS owners,
       min(CASE WHEN {LEASED} THEN j.heartbeat_at END) AS oldest_heartbeat,
       max(CASE WHEN {LEASED} THEN j.heartbeat_at END) AS latest_heartbeat
FROM jobs j JOIN tasks t ON t.id = j.task_id WHERE t.deleted_at IS NULL""")
def _(d):
    return metrics.queue_summary(d.jobs, d.tasks, ORDERS_AS_OF)


@query("leases_by_kind", f"""
SELECT k.kind, count(q.id) AS lease_count
FROM (VALUES ('scan'), ('image'), ('native'), ('bytecode'), ('trivy'), ('report'), ('decompile'),
      ('c_analysis'), ('java_analysis')) AS k(kind)
LEFT JOIN (SELECT j.id, j.kind FROM jobs j JOIN tasks t ON t.id = j.task_id
           WHERE t.deleted_at IS NULL AND {LEASED}) q ON q.kind = k.kind
GROUP BY k.kind""")
def _(d):
    return metrics.leases_by_kind(d.jobs, d.tasks, ORDERS_AS_OF)


TRANSITIONS = f"""
WITH numbered AS (
  SELECT task_id, event_sequence, created_at, upper(stage) AS stage,
         row_number() OVER (PARTITION BY task_id ORDER BY event_sequence)
         - row_number() OVER (PARTITION BY task_id, upper(stage) ORDER BY event_sequence) AS island
  FROM task_events
  WHERE stage IS NOT NULL AND created_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 168 HOUR
), visits AS (
  SELECT task_id, stage, min(event_sequence) AS event_sequence,
         arg_min(created_at, event_sequence) AS started_at
  FROM numbered GROUP BY task_id, stage, island
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY event_sequence) AS place FROM visits
), timed AS (
  SELECT a.*, b.started_at AS completed_at FROM placed a
  LEFT JOIN placed b ON b.task_id = a.task_id AND b.place = a.place + 1
)"""
LISTED = "stage IN ('VALIDATING','IDENTIFYING','EXTRACTING','INDEXING','SCANNING','REPORTING')"


@query("stage_transitions", f"""{TRANSITIONS}
SELECT a.task_id, a.event_sequence, a.stage, a.started_at AS created_at, b.stage AS previous_stage
FROM placed a LEFT JOIN placed b ON b.task_id = a.task_id AND b.place + 1 = a.place""")
def _(d):
    return metrics.stage_transitions(d.task_events, EVENTS_AS_OF)


@query("stage_intervals", f"""{TRANSITIONS}
SELECT task_id, event_sequence, stage, started_at, completed_at FROM timed
WHERE completed_at IS NOT NULL AND completed_at >= started_at AND {LISTED}""")
def _(d):
    return metrics.stage_intervals(d.task_events, EVENTS_AS_OF)


STAGE_DURATIONS = f"""{TRANSITIONS}, spans AS (
  SELECT stage, epoch_us(completed_at) - epoch_us(started_at) AS micros FROM timed
)
SELECT stage, count(micros) AS sample_count,
       CAST(round(sum(micros)::DECIMAL(38,6) / count(micros) / 1000) AS BIGINT) AS average_duration_ms,
       list_position(['VALIDATING', 'IDENTIFYING', 'EXTRACTING', 'INDEXING', 'SCANNING', 'REPORTING'],
                     stage) AS stage_order
FROM spans WHERE micros >= 0 AND {LISTED} GROUP BY stage"""


@query("stage_durations", STAGE_DURATIONS)
def _(d):
    return metrics.stage_durations(d.task_events, EVENTS_AS_OF)


@query("stage_order", STAGE_DURATIONS + " ORDER BY stage_order")
def _(d):
    return metrics.stage_durations(d.task_events, EVENTS_AS_OF).orderBy("stage_order")


@query("analyzer_failure_rates", f"""
SELECT analyzer_name, count(*) AS total_runs,
       count(*) FILTER (status IN ('failed', 'timed_out')) AS failed_runs,
       CAST(round(count(*) FILTER (status IN ('failed', 'timed_out')) * 10000::DECIMAL(20,6)
                  / count(*)) AS BIGINT) AS failure_rate_basis_points
FROM analyzer_runs
WHERE status IN ('succeeded', 'partial', 'failed', 'cancelled', 'timed_out')
  AND created_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 168 HOUR
GROUP BY analyzer_name""")
def _(d):
    return metrics.analyzer_failure_rates(d.analyzer_runs, ORDERS_AS_OF)


OBSERVED = """
newest AS (SELECT *, lower(trim(analyzer_name)) AS analyzer_key FROM analyzer_runs
          ),
observed AS (SELECT * FROM newest WHERE analyzer_key <> ''
             QUALIFY row_number() OVER (PARTITION BY analyzer_key
                                        ORDER BY created_at DESC, id DESC) = 1)"""


@query("observed_analyzers", f"""
WITH {OBSERVED}
SELECT id, analyzer_name, analyzer_version, created_at, analyzer_key FROM observed""")
def _(d):
    return metrics.observed_analyzers(d.analyzer_runs)


@query("latest_bundle", """
SELECT id, version, generated_at, registered_at FROM database_bundles
ORDER BY registered_at DESC, id DESC LIMIT 1""")
def _(d):
    return metrics.latest_bundle(d.database_bundles)


@query("database_age_days", f"""
SELECT id, version, greatest(0, (epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(generated_at))
                                // 86400000000) AS age_days
FROM database_bundles ORDER BY registered_at DESC, id DESC LIMIT 1""")
def _(d):
    return metrics.database_age_days(d.database_bundles, EVENTS_AS_OF)


OVERVIEW_ACTIVE = """('UPLOADING', 'QUEUED', 'VALIDATING', 'IDENTIFYING', 'EXTRACTING', 'INDEXING',
  'SCANNING', 'REPORTING', 'RUNNING', 'CANCEL_REQUESTED')"""


@query("overview", f"""
SELECT count(*) AS total, count(*) FILTER (status IN {OVERVIEW_ACTIVE}) AS active,
       count(*) FILTER (status = 'FAILED' OR risk_level IN ('HIGH', 'CRITICAL')) AS attention,
       count(*) FILTER (status = 'QUEUED') AS queued
FROM (SELECT * FROM tasks WHERE deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 8)""")
def _(d):
    return metrics.overview(d.tasks)


@query("attention_tasks", f"""
SELECT id, status, risk_level, status IN {OVERVIEW_ACTIVE} AS is_active,
       status = 'QUEUED' AS is_queued
FROM tasks WHERE status = 'FAILED' OR risk_level IN ('HIGH', 'CRITICAL')""")
def _(d):
    return metrics.attention_tasks(d.tasks)


@query("storage_usage", """
SELECT mount, total_bytes, free_bytes, minimum_free_bytes, p AS used_percent,
       CASE WHEN p >= 90 THEN 'critical' WHEN p >= 80 THEN 'warning' ELSE 'normal' END AS level,
       free_bytes < minimum_free_bytes * 2 AS near_low_water
FROM (SELECT *, CAST(CASE WHEN total_bytes = 0 THEN 100
        ELSE round((total_bytes - free_bytes) * 100.0::DOUBLE / total_bytes) END AS BIGINT) AS p
      FROM storage_mounts)""")
def _(d):
    return metrics.storage_usage(d.storage_mounts)


FRESH = f"""(status = 'ready' AND last_checked_at BETWEEN TIMESTAMP '{EVENTS_AS_OF}'
  - INTERVAL 45 SECOND AND TIMESTAMP '{EVENTS_AS_OF}' + INTERVAL 45 SECOND)"""


@query("readiness_fresh", f"SELECT worker_owner, worker_kind FROM worker_readiness WHERE {FRESH}")
def _(d):
    return metrics.readiness_fresh(d.worker_readiness, EVENTS_AS_OF).select(
        "worker_owner", "worker_kind"
    )


@query("stale_workers", f"SELECT worker_owner, worker_kind FROM worker_readiness WHERE NOT {FRESH}")
def _(d):
    return metrics.stale_workers(d.worker_readiness, EVENTS_AS_OF).select(
        "worker_owner", "worker_kind"
    )


@query("analyzer_status", f"""
WITH {OBSERVED},
beats AS (SELECT *, lower(trim(analyzer_name)) AS k, {FRESH} AS fresh
          FROM (SELECT * FROM worker_readiness
                )),
live AS (SELECT r.name, r.scope, r.required_kinds, lower(r.name) AS k,
           count(*) FILTER (b.fresh AND b.analyzer_version = r.version) AS ready_workers,
           list_sort(coalesce(list(DISTINCT b.worker_kind)
                     FILTER (b.fresh AND b.analyzer_version = r.version), [])) AS ready,
           count(*) FILTER (b.fresh AND b.analyzer_version <> r.version) > 0 AS mismatch,
           max(b.last_checked_at) AS last_checked_at
         FROM analyzer_registrations r LEFT JOIN beats b ON b.k = lower(r.name)
         GROUP BY ALL),
missing AS (SELECT *, list_sort(list_filter(string_split(required_kinds, ','),
                      lambda x: NOT list_contains(ready, x))) AS missing FROM live),
both_parts AS (
  SELECT 0 AS part, name, scope, CASE WHEN NOT mismatch AND len(missing) = 0 AND ready_workers > 0
         THEN 'available' ELSE 'unavailable' END AS status, ready_workers,
         array_to_string(ready, ',') AS ready_kinds, array_to_string(missing, ',') AS missing_kinds,
         mismatch, last_checked_at, o.created_at AS last_run_at
  FROM missing LEFT JOIN observed o ON o.analyzer_key = k
  UNION ALL
  SELECT 1, analyzer_name, 'historical', 'unavailable', 0, '', '', false, NULL, created_at
  FROM observed WHERE analyzer_key NOT IN (SELECT lower(name) FROM analyzer_registrations))
SELECT name, scope, status, ready_workers, ready_kinds, missing_kinds, mismatch, last_checked_at,
       last_run_at
FROM both_parts""")
def _(d):
    observed = metrics.observed_analyzers(d.analyzer_runs)
    return metrics.analyzer_status(
        d.analyzer_registrations, d.worker_readiness, observed, EVENTS_AS_OF
    )


@query("required_minus_ready", f"""
WITH fresh AS (SELECT lower(trim(analyzer_name)) AS k, list(worker_kind) AS kinds
               FROM worker_readiness WHERE {FRESH} GROUP BY 1)
SELECT r.name, array_to_string(list_sort(list_filter(string_split(r.required_kinds, ','),
         lambda x: NOT list_contains(COALESCE(f.kinds, []), x))), ',') AS missing_kinds
FROM analyzer_registrations r LEFT JOIN fresh f ON f.k = lower(r.name)""")
def _(d):
    rows = metrics.required_minus_ready(
        d.analyzer_registrations, d.worker_readiness, EVENTS_AS_OF
    )
    return rows.select("name", F.array_join("missing_kinds", ",").alias("missing_kinds"))


@query("last_sequence", """
SELECT t.id AS task_id, COALESCE(max(e.event_sequence), 0) + 1 AS next_sequence
FROM tasks t LEFT JOIN task_events e ON e.task_id = t.id GROUP BY t.id""")
def _(d):
    return metrics.last_sequence(d.tasks, d.task_events)


@query("attempt_high_water", """
SELECT task_id, max(attempt_number) AS attempt_number, max(fencing_token) AS fencing_token
FROM task_attempts GROUP BY task_id""")
def _(d):
    return metrics.attempt_high_water(d.task_attempts)


@query("latest_attempt", """
SELECT task_id, id, attempt_number, status FROM task_attempts
QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt_number DESC, id DESC) = 1""")
def _(d):
    return metrics.latest_attempt(d.task_attempts).select(
        "task_id", "id", "attempt_number", "status"
    )


@query("file_type_summary", """
SELECT task_id, COALESCE(NULLIF(format, ''), 'unknown') AS format, count(*) AS file_count,
       COALESCE(sum(size_bytes), 0)::BIGINT AS total_bytes
FROM file_nodes WHERE node_type = 'file' GROUP BY ALL""")
def _(d):
    return metrics.file_type_summary(d.file_nodes)


@query("top_formats", """
SELECT COALESCE(NULLIF(format, ''), 'unknown') AS format, count(*) AS file_count,
       sum(size_bytes)::BIGINT AS total_bytes
FROM file_nodes WHERE node_type = 'file' GROUP BY 1 ORDER BY file_count DESC, format LIMIT 5""")
def _(d):
    return metrics.top_formats(d.file_nodes, 5)
