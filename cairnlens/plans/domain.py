"""Domain tables as views over the input tables.

Each view is written once, in SQL that both Spark and the checking database
accept, so a query and its check read the same rows. The operators themselves are
written twice, independently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairnlens import schemas
from cairnlens.session import apply_settings
from cairnlens.sources.tables import scan_table

BLOB_COUNT = "(SELECT count(*) FROM documents)"


def _blob(key: str) -> str:
    """A blob for a key; two blobs of three are never referenced."""
    return f"{key} % {BLOB_COUNT} - {key} % {BLOB_COUNT} % 3"


VIEWS: dict[str, str] = {
    # one key per line item row; (l_orderkey, l_linenumber) alone is not unique
    "lines": """
        SELECT *, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
                         CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS line_key
        FROM lineitem""",
    "users": """
        SELECT c_custkey AS id, concat('u-', c_custkey) AS public_id, c_name AS username,
               concat(c_mktsegment, ' ', c_name) AS display_name, c_mktsegment AS role,
               CASE WHEN c_custkey % 7 = 0 THEN 'disabled' ELSE 'active' END AS status,
               CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-02-15 00:00:00' END AS locked_until
        FROM customer""",
    "task_events": """
        SELECT user_id AS task_id, event_id AS event_sequence, event_type,
               CASE event_type WHEN 'view' THEN 'validating' WHEN 'click' THEN 'IDENTIFYING'
                    WHEN 'signup' THEN 'EXTRACTING' WHEN 'purchase' THEN 'SCANNING' END AS stage,
               CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning'
                    ELSE 'info' END AS severity,
               CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('event ', event_id) END AS message,
               props AS payload, ts AS created_at
        FROM events""",
    "audit_logs": """
        SELECT event_id AS id, user_id AS actor_user_id, event_type AS action,
               CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
               concat('{"k":', event_id % 50, ',"user password":"p","nested":{"api_token":"t",',
                      '"note":"n', event_id % 9, '","deep":{"cookie":"c","ok":true}},',
                      '"session_id":"s","path":"/p/', event_id % 13, '"}') AS metadata_json,
               ts AS created_at
        FROM events""",
    "tasks": f"""
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 5 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS upload_id,
               {_blob('o_orderkey')} AS blob_id, o_custkey AS created_by,
               concat('Sample ', o_orderkey,
                      CASE WHEN o_orderkey % 9 = 0 THEN ' 100%_done' ELSE '' END) AS name,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    ELSE concat('["', o_orderpriority, '","t', o_orderkey % 5, '"]') END AS tags,
               CASE WHEN o_orderkey % 13 = 5 THEN 'DELETING' WHEN o_orderkey % 13 = 6 THEN 'QUEUED'
                    WHEN o_orderkey % 13 = 7 THEN 'SCANNING'
                    WHEN o_orderkey % 13 = 8 THEN 'CANCEL_REQUESTED'
                    WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'SUCCEEDED'
                    ELSE 'PARTIAL_SUCCEEDED' END AS status,
               CASE WHEN o_orderkey % 13 = 6 THEN 'QUEUED' WHEN o_orderkey % 13 = 7 THEN 'SCANNING'
                    WHEN o_orderkey % 3 = 0 THEN 'extracting' ELSE 'REPORTING' END AS stage,
               CAST((o_orderkey * 37) % 10001 AS INT) AS progress_basis_points,
               CASE o_orderkey % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'NONE' WHEN 2 THEN 'LOW'
                    WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
               CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'PE32'
                    WHEN 3 THEN 'elf64' WHEN 4 THEN 'zip' WHEN 5 THEN 'docker-tar'
                    ELSE 'ext4' END AS root_format,
               CASE WHEN o_orderstatus <> 'F' THEN NULL WHEN o_orderkey % 3 = 0 THEN ''
                    ELSE 'scan_failed' END AS error_code,
               CASE WHEN o_orderstatus <> 'F' THEN NULL WHEN o_orderkey % 5 = 0 THEN ''
                    ELSE 'The scan failed.' END AS error_message,
               o_orderkey % 40 AS event_sequence,
               o_orderdate + INTERVAL 15 DAY AS sample_expires_at,
               CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL 20 DAY END
                   AS sample_deleted_at,
               CASE WHEN o_orderkey % 97 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS deleted_at,
               o_orderdate AS created_at, o_orderdate + INTERVAL 1 HOUR AS updated_at
        FROM orders""",
    "task_attempts": """
        SELECT line_key AS id, l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS attempt_number,
               l_partkey % 1000 AS fencing_token,
               CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed'
                    ELSE 'running' END AS status,
               l_shipdate AS started_at
        FROM lines""",
    "jobs": """
        SELECT o_orderkey AS id, o_orderkey - o_orderkey % 2 AS task_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'scan' WHEN 1 THEN 'image' WHEN 2 THEN 'decompile'
                    ELSE 'report' END AS kind,
               CASE WHEN o_orderkey % 20 = 0 THEN 'queued' WHEN o_orderkey % 20 = 1 THEN 'leased'
                    WHEN o_orderkey % 20 = 2 THEN 'running'
                    WHEN o_orderkey % 20 = 3 THEN 'cancel_requested'
                    WHEN o_orderkey % 20 < 12 THEN 'succeeded'
                    WHEN o_orderkey % 20 < 16 THEN 'failed' ELSE 'cancelled' END AS status,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('w-', o_custkey % 16) END
                   AS lease_owner,
               o_orderdate + INTERVAL 1 DAY AS lease_until,
               o_orderdate + INTERVAL 12 HOUR AS heartbeat_at,
               concat('{"target":{"file_node_id":"', o_orderkey % 25,
                      '"},"sources":[{"image_logical_path":"/img/', o_orderkey % 10, '"}',
                      CASE WHEN o_orderkey % 3 = 0 THEN ',{"image_logical_path":"/img/x"}'
                           ELSE '' END, ']}') AS payload,
               o_orderdate AS created_at
        FROM orders""",
    "job_slots": "SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 41 = 0",
    "uploads": f"""
        SELECT o_orderkey AS id, o_custkey AS created_by,
               concat('sample-', o_orderkey - o_orderkey % 6, '.bin') AS display_name,
               CAST(floor(o_totalprice) AS BIGINT) AS declared_size_bytes,
               CASE o_orderkey % 5 WHEN 0 THEN 'expired' WHEN 1 THEN 'cancelled'
                    ELSE 'completed' END AS status,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {_blob('o_orderkey')} END AS blob_id,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE concat('sha-', o_orderkey % 1000) END
                   AS actual_sha256,
               o_orderdate + INTERVAL 7 DAY AS expires_at, o_orderdate AS created_at,
               o_orderdate + INTERVAL 2 HOUR AS updated_at,
               CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 3 HOUR END
                   AS parts_cleaned_at
        FROM orders""",
    "upload_parts": """
        SELECT l_orderkey AS upload_id, CAST(l_linenumber AS BIGINT) AS part_number,
               CAST(l_quantity AS BIGINT) AS size_bytes,
               concat('p-', l_partkey % 7) AS sha256,
               CASE WHEN l_suppkey % 10 = 0 THEN 'p-x' ELSE concat('p-', l_partkey % 7) END
                   AS actual_sha256
        FROM lineitem""",
    "part_uploads": """
        SELECT l_orderkey AS id,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)
                   + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS declared_size_bytes
        FROM lineitem GROUP BY l_orderkey""",
    "blobs": """
        SELECT doc_id AS id, sha2(text, 256) AS sha256, octet_length(text) AS size_bytes,
               concat('blobs/sha256/', substr(sha2(text, 256), 1, 2), '/', sha2(text, 256))
                   AS storage_key,
               doc_id % 5 AS reference_count,
               CASE doc_id % 7 WHEN 4 THEN 'staging' WHEN 5 THEN 'deleting' WHEN 6 THEN 'deleted'
                    ELSE 'available' END AS state,
               TIMESTAMP '1999-01-01 00:00:00' + INTERVAL 1 DAY * (doc_id % 365) AS created_at
        FROM documents""",
    "store_inventory": """
        SELECT concat('blobs/sha256/', substr(sha2(text, 256), 1, 2), '/', sha2(text, 256))
                   AS storage_key, octet_length(text) AS size_bytes,
               TIMESTAMP '1999-01-01 00:00:00' + INTERVAL 1 DAY * (doc_id % 365) AS modified_at
        FROM documents
        UNION ALL
        SELECT concat('blobs/sha256/', substr(sha2(html, 256), 1, 2), '/', sha2(html, 256)),
               octet_length(html),
               TIMESTAMP '1999-01-01 00:00:00' + INTERVAL 1 DAY * (page_id % 365)
        FROM pages""",
    "intake_profiles": """
        SELECT o_orderkey AS upload_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'archive'
                    ELSE 'container' END AS input_category,
               CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'archive'
                    WHEN o_orderkey % 3 = 0 THEN 'binary' WHEN o_orderkey % 3 = 1 THEN 'archive'
                    ELSE 'container' END AS detected_category,
               CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'zip'
                    WHEN o_orderkey % 3 = 0 THEN 'elf64' WHEN o_orderkey % 3 = 1 THEN 'zip'
                    ELSE 'docker-tar' END AS detected_format,
               CASE WHEN o_orderkey % 14 = 0 THEN 'unsupported'
                    WHEN o_orderkey % 11 = 0 AND o_orderkey % 3 <> 1 THEN 'mismatch'
                    ELSE 'valid' END AS validation_status,
               CASE WHEN o_orderkey % 6 = 0 THEN 'archive_entry' ELSE 'direct' END AS source_kind,
               CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey + 1 END AS source_parent_upload_id,
               CASE WHEN o_orderkey % 6 = 0 THEN concat('sample-', o_orderkey, '.bin') END
                   AS source_archive_name,
               CASE WHEN o_orderkey % 6 = 0 THEN concat('dir/', o_orderkey, '.bin') END
                   AS source_entry_path,
               CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 <> 1 THEN o_orderkey END
                   AS archive_import_id
        FROM orders""",
    "archive_imports": f"""
        SELECT o_orderkey AS id, o_orderkey AS upload_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running'
                    WHEN 2 THEN 'completed' ELSE 'deleting' END AS status,
               {_blob('o_orderkey')} AS source_blob_id,
               CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS source_blob_released_at,
               o_orderdate AS created_at
        FROM orders WHERE o_orderkey % 3 = 1""",
    "archive_import_entries": f"""
        SELECT concat('o-', o_orderkey) AS id, o_orderkey + 1 AS archive_import_id,
               CASE WHEN o_orderkey % 8 = 0 THEN concat('dir/x', o_orderkey, '.bin')
                    ELSE concat('dir/', o_orderkey, '.bin') END AS logical_path,
               CASE o_orderkey % 4 WHEN 0 THEN 'eligible' WHEN 2 THEN 'created'
                    ELSE 'failed' END AS status,
               CAST(NULL AS STRING) AS skip_reason,
               CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END
                   AS size_bytes,
               concat('sha-', o_orderkey % 1000) AS sha256,
               'binary' AS detected_category, 'elf64' AS detected_format,
               {_blob('o_orderkey')} AS blob_id,
               CASE WHEN o_orderkey % 12 = 0 THEN o_orderkey END AS derived_upload_id,
               CASE WHEN o_orderkey % 36 = 0 THEN o_orderkey END AS task_id,
               CASE WHEN o_orderkey % 18 = 0 THEN o_orderdate END AS blob_released_at
        FROM orders WHERE o_orderkey % 6 = 0
        UNION ALL
        SELECT concat('l-', line_key), l_orderkey - l_orderkey % 3 + 1,
               concat('pkg/', l_suppkey, '/', l_partkey, '.bin'),
               CASE l_linenumber % 4 WHEN 0 THEN 'eligible' WHEN 1 THEN 'created'
                    WHEN 2 THEN 'failed' ELSE 'skipped' END,
               CASE WHEN l_linenumber % 4 = 3 THEN
                    CASE l_partkey % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'encrypted'
                         WHEN 2 THEN 'nested_archive' ELSE 'unsupported_format' END END,
               CAST(floor(l_extendedprice) AS BIGINT), concat('sha-', l_partkey % 1000),
               'binary', 'pe32', {_blob('l_partkey')}, CAST(NULL AS BIGINT),
               CAST(NULL AS BIGINT), CASE WHEN l_returnflag = 'R' THEN l_shipdate END
        FROM lines""",
    "batch_items": """
        SELECT l_orderkey AS batch_id, line_key AS id,
               CASE WHEN l_suppkey % 10 = 0 THEN 'pending' WHEN l_suppkey % 10 = 1 THEN 'processing'
                    WHEN l_suppkey % 10 < 8 THEN 'created' ELSE 'failed' END AS outcome
        FROM lines""",
    "batches": """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'completed' ELSE 'processing' END AS status,
               o_orderdate AS updated_at
        FROM orders""",
    "reports": """
        SELECT o_orderkey AS id, o_orderkey - o_orderkey % 4 AS task_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'html' ELSE 'docx' END AS format,
               CASE WHEN o_orderkey % 10 = 0 THEN 'queued' WHEN o_orderkey % 10 = 1 THEN 'generating'
                    WHEN o_orderkey % 10 < 9 THEN 'complete' ELSE 'failed' END AS status,
               CASE WHEN o_orderkey % 10 < 2 THEN 'staged' WHEN o_orderkey % 7 = 0 THEN 'superseded'
                    ELSE 'current' END AS snapshot_state,
               o_orderkey % 5 AS generation,
               CASE WHEN o_orderkey % 6 = 5 THEN NULL
                    ELSE concat('reports/', o_orderkey - o_orderkey % 8) END AS storage_key,
               CASE WHEN o_orderkey % 6 = 4 THEN NULL ELSE o_orderkey - o_orderkey % 2 END
                   AS artifact_id,
               CASE WHEN o_orderkey % 31 = 0 THEN o_orderdate END AS deleted_at,
               o_orderdate AS created_at
        FROM orders""",
    "artifacts": """
        SELECT o_orderkey AS id, concat('artifacts/', o_orderkey) AS storage_key,
               CASE o_orderkey % 5 WHEN 0 THEN 'staged' WHEN 1 THEN 'published'
                    WHEN 2 THEN 'deleting' WHEN 3 THEN 'deleted' ELSE 'failed' END AS state,
               CASE WHEN o_orderkey % 37 = 0 THEN o_orderdate END AS deleted_at
        FROM orders""",
    "stored_files": """
        SELECT CASE o_orderkey % 4 WHEN 0 THEN 'report' WHEN 1 THEN 'report_staging'
                    WHEN 2 THEN 'artifact' ELSE 'decompile' END AS kind,
               CASE o_orderkey % 4 WHEN 0 THEN concat('reports/', o_orderkey)
                    WHEN 1 THEN concat('staging/', o_orderkey - o_orderkey % 4, '/', o_orderkey)
                    WHEN 2 THEN concat('artifacts/', o_orderkey)
                    ELSE concat('decompile/', o_orderkey) END AS storage_key,
               o_orderdate AS modified_at
        FROM orders""",
    "retention_operations": """
        SELECT o_orderkey AS task_id,
               CASE WHEN o_orderkey % 38 = 0 THEN 'completed' ELSE 'cleaning' END AS status,
               o_orderdate + INTERVAL 30 DAY AS lease_until
        FROM orders WHERE o_orderkey % 19 = 0""",
    "deletion_operations": """
        SELECT o_orderkey AS task_id,
               CASE WHEN o_orderkey % 46 = 0 THEN 'completed' ELSE 'cleaning' END AS status,
               o_orderdate + INTERVAL 30 DAY AS lease_until
        FROM orders WHERE o_orderkey % 23 = 0""",
    "project_deletions": """
        SELECT c_custkey AS active_project_id, c_custkey AS task_id,
               CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'cancelling'
                    WHEN 2 THEN 'deleting' WHEN 3 THEN 'failed' ELSE 'completed' END AS status
        FROM customer WHERE c_custkey % 8 = 0""",
    "analyzer_runs": """
        SELECT o_orderkey AS id, o_orderkey AS task_id, o_orderkey AS job_id,
               CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_orderkey % 25 END AS file_node_id,
               CASE WHEN o_orderkey % 10 = 0 THEN 'ghidra' WHEN o_orderkey % 33 = 0 THEN ' '
                    ELSE o_orderpriority END AS analyzer_name,
               concat('v', o_orderkey % 3) AS analyzer_version,
               CASE o_orderkey % 6 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed'
                    WHEN 3 THEN 'cancelled' WHEN 4 THEN 'timed_out' ELSE 'running' END AS status,
               CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL
                    ELSE 'tool_error' END AS error_code,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'The tool stopped.' END AS error_message,
               o_orderdate AS created_at,
               CASE WHEN o_orderkey % 6 <> 5 THEN o_orderdate + INTERVAL 2 HOUR END AS completed_at,
               o_orderkey % 9 AS declared_finding_count, o_orderkey % 5 AS declared_bundle_id,
               concat('{"database_bundle":{"id":"', o_orderkey % 4, '"},"result_count":',
                      o_orderkey % 7, '}') AS parameters_json
        FROM orders""",
    "decompile_results": """
        SELECT line_key AS id, l_orderkey AS task_id, l_orderkey AS analyzer_run_id,
               l_orderkey % 25 AS file_node_id,
               concat('0x', l_partkey) AS symbol_key,
               CASE WHEN l_orderkey % 3 = 0 THEN 'java'
                    ELSE CASE l_partkey % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'kotlin'
                              WHEN 2 THEN 'python' ELSE 'bytecode' END END AS language,
               CASE WHEN l_orderkey % 4 = 0 THEN 'complete'
                    ELSE CASE l_linenumber WHEN 1 THEN 'complete' WHEN 2 THEN 'partial'
                         WHEN 3 THEN 'bytecode_only' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'failed'
                         WHEN 6 THEN 'cancelled' ELSE 'running' END END AS status,
               CASE WHEN l_suppkey % 9 = 0 THEN NULL
                    ELSE concat('decompile/', l_orderkey, CASE WHEN l_linenumber > 3 THEN '/b'
                                                               ELSE '' END) END AS storage_key,
               concat('c-', l_partkey) AS content_sha256,
               CAST(l_quantity AS BIGINT) * 100 AS size_bytes,
               concat('{"symbol_kind":"', CASE l_partkey % 3 WHEN 0 THEN 'Function' WHEN 1 THEN 'odd'
                      ELSE '' END, '","symbol":{"kind":"method","name":"n', l_partkey,
                      '"},"location":"0x', l_suppkey, '"}') AS diagnostics_json,
               l_partkey * 16 AS source_offset_bytes,
               CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END
                   AS source_length_bytes,
               l_partkey AS source_start_line,
               l_partkey + l_linenumber - CASE WHEN l_suppkey % 25 = 0 THEN 5 ELSE 0 END
                   AS source_end_line,
               l_shipdate AS created_at,
               CASE WHEN l_linenumber < 7 THEN l_shipdate + INTERVAL 1 HOUR END AS completed_at,
               CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN l_shipdate + INTERVAL 5 DAY
                    END AS deleted_at
        FROM lines""",
    # runs of the result cache: a running run may reuse a finished one
    "cache_runs": """
        SELECT o_orderkey AS id, o_orderkey AS task_id, o_orderkey % 25 AS file_node_id,
               o_orderpriority AS analyzer_name, concat('v', o_orderkey % 2) AS analyzer_version,
               concat('cache-', o_custkey % 40) AS cache_identity,
               CASE WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 3 = 1 THEN 'succeeded'
                    ELSE 'failed' END AS status,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 2 HOUR END AS completed_at,
               concat('{"analyzer_parameters_sha256":"a', o_custkey % 2,
                      '","cache_parameters_sha256":"b","reuse_identity_sha256":"r',
                      o_custkey % 40, '","reuse_contract":"v1","engine_target":"e",',
                      '"source_sha256":"s', o_custkey % 40, '","source_size_bytes":"10",',
                      '"source_format":"jar","source_architecture":"jvm",',
                      '"result_status":"', CASE WHEN o_orderkey % 5 = 0 THEN 'partial'
                                                ELSE 'complete' END,
                      '","result_count":', 1 + o_orderkey % 4, '}') AS parameters_json
        FROM orders""",
    "cache_results": """
        SELECT line_key AS id, l_orderkey AS task_id, l_orderkey AS analyzer_run_id,
               l_orderkey % 25 AS file_node_id, o_orderpriority AS engine_name,
               concat('v', l_orderkey % 2) AS engine_version,
               CASE WHEN l_suppkey % 33 = 0 THEN 'failed' ELSE 'complete' END AS status,
               concat('decompile/', l_orderkey) AS storage_key, concat('c-', l_partkey)
                   AS content_sha256,
               CAST(l_quantity AS BIGINT) AS size_bytes,
               concat('{"n":', l_partkey, '}') AS diagnostics_json,
               l_shipdate AS completed_at, CAST(NULL AS TIMESTAMP) AS deleted_at
        FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "database_bundles": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS version,
               TIMESTAMP '2024-01-10 06:00:00' + INTERVAL 1 DAY * r_regionkey AS generated_at,
               TIMESTAMP '2024-01-12 06:00:00' + INTERVAL 1 DAY * (r_regionkey % 3)
                   AS registered_at
        FROM region""",
    "vulnerability_findings": """
        SELECT line_key AS id, l_orderkey AS task_id, l_orderkey AS analyzer_run_id,
               CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END AS database_bundle_id,
               concat('/img/', l_linenumber) AS image_logical_path,
               concat('CVE-', l_partkey) AS vulnerability_id,
               CASE l_partkey % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM'
                    WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
               concat('pkg-', l_partkey % 500) AS package_name,
               concat('1.', l_suppkey % 10) AS installed_version,
               CASE l_returnflag WHEN 'A' THEN concat('1.', l_linenumber) WHEN 'R' THEN '  '
                    END AS fixed_version,
               l_shipdate AS created_at
        FROM lines""",
    "source_projects": """
        SELECT c_custkey AS id, c_custkey AS task_id,
               CASE WHEN c_custkey % 6 = 0 THEN 'legacy-v1' ELSE 'project-v1' END AS layout_version,
               concat('projects/', c_custkey - c_custkey % 2) AS root_storage_key,
               CASE WHEN c_custkey % 10 = 9 THEN 'broken' ELSE 'complete' END AS status,
               concat('canonical/', c_custkey) AS canonical_storage_key,
               c_custkey * 10 AS canonical_size_bytes,
               CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP '1999-01-01 00:00:00' END AS deleted_at,
               CASE WHEN c_custkey % 27 = 0 THEN TIMESTAMP '1999-02-01 00:00:00' END
                   AS storage_deleted_at
        FROM customer""",
    "project_folders": """
        SELECT c_custkey AS project_id, concat('projects/', c_custkey) AS storage_key
        FROM customer
        UNION ALL
        SELECT s_suppkey + 10000000, concat('projects/s', s_suppkey) FROM supplier""",
    "rule_runs": """
        SELECT o_orderkey AS id, o_custkey AS task_id, o_custkey AS source_project_id,
               o_orderkey AS job_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'java' ELSE 'python' END AS language,
               CASE WHEN o_orderkey % 8 < 4 THEN 'succeeded' WHEN o_orderkey % 8 = 4 THEN 'partial'
                    WHEN o_orderkey % 8 = 5 THEN 'failed' WHEN o_orderkey % 8 = 6 THEN 'running'
                    ELSE 'queued' END AS status,
               concat('src-', o_custkey) AS source_sha256, o_orderkey % 9 AS finding_count,
               o_orderdate AS created_at,
               CASE WHEN o_orderkey % 8 < 6 THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
               CASE WHEN o_orderkey % 29 = 0 THEN o_orderdate + INTERVAL 2 HOUR END
                   AS deletion_started_at
        FROM orders""",
    "rule_run_analyzers": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_custkey END AS task_id,
               'rules' AS analyzer_name, concat('v', o_orderkey % 2) AS analyzer_version
        FROM orders""",
    "rule_jobs": """
        SELECT o_orderkey AS id, o_custkey AS task_id,
               CASE WHEN o_orderkey % 50 = 0 THEN 'running' ELSE 'succeeded' END AS status
        FROM orders""",
    "rule_findings": """
        SELECT line_key AS id, l_orderkey AS run_id,
               CASE l_partkey % 7 WHEN 0 THEN 'CWE-242' WHEN 1 THEN 'CWE-120' WHEN 2 THEN 'CWE-134'
                    WHEN 3 THEN 'CWE-78' WHEN 4 THEN 'CWE-377' WHEN 5 THEN 'CWE-328'
                    ELSE 'CWE-999' END AS cwe,
               CASE l_partkey % 7 WHEN 0 THEN 'cwe-242-gets' WHEN 1 THEN 'cwe-120-bounds'
                    WHEN 2 THEN 'cwe-134-format' WHEN 3 THEN 'cwe-78-command'
                    WHEN 4 THEN 'cwe-242-gets' WHEN 5 THEN 'cwe-327-328-weak-crypto'
                    ELSE 'cwe-000' END AS rule_id,
               CASE l_suppkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH'
                    WHEN 3 THEN 'CRITICAL' ELSE 'odd' END AS severity,
               concat('fn_', l_partkey % 97) AS function_name,
               concat('src/main/java/p', l_suppkey % 10, '/C', l_partkey % 50, '.java')
                   AS logical_path,
               concat('Type', l_suppkey % 7) AS type_name,
               concat('call', l_partkey % 13) AS callable_name,
               CAST(l_linenumber AS BIGINT) * 10 + l_suppkey % 10 AS start_line,
               1 + l_partkey % 80 AS start_column,
               CAST(l_linenumber AS BIGINT) * 10 + l_suppkey % 12 AS end_line,
               1 + l_suppkey % 80 AS end_column,
               CASE WHEN l_partkey % 40 = 0 THEN '' ELSE concat('message ', l_partkey) END AS message,
               concat('snippet ', l_suppkey) AS snippet
        FROM lines""",
    "project_functions": """
        SELECT o_custkey AS project_id, o_orderkey AS result_id,
               CAST(floor(o_totalprice) AS BIGINT) AS offset_bytes,
               100 + o_orderkey % 500 AS length_bytes,
               CAST(floor(o_totalprice / 50) AS BIGINT) AS start_line,
               CAST(floor(o_totalprice / 50) AS BIGINT) + o_orderkey % 40 AS end_line
        FROM orders""",
    "project_hits": """
        SELECT line_key AS hit_id, l_suppkey AS project_id,
               CAST(floor(l_extendedprice / 10) AS BIGINT) AS start_line,
               CAST(floor(l_extendedprice / 10) AS BIGINT) + l_linenumber % 3 AS end_line
        FROM lines""",
    "file_nodes": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id,
               CAST(1 AS BIGINT) AS task_id, concat('/', r_name) AS logical_path,
               r_name AS display_name, 'directory' AS node_type, 1 AS depth,
               CAST(NULL AS STRING) AS format, CAST(0 AS BIGINT) AS size_bytes,
               'indexed' AS extraction_status, CAST(NULL AS STRING) AS metadata_json,
               CAST(NULL AS STRING) AS error_code, CAST(NULL AS STRING) AS error_message,
               CAST(NULL AS BIGINT) AS source_container_id,
               TIMESTAMP '1999-01-01 00:00:00' AS created_at
        FROM region
        UNION ALL
        SELECT 100 + n_nationkey, n_regionkey + 1, 1, concat('/', r_name, '/', n_name), n_name,
               'directory', 2, NULL, 0, 'indexed', NULL, NULL, NULL, NULL,
               TIMESTAMP '1999-01-01 00:00:00'
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL
        SELECT 1000 + c_custkey,
               CASE WHEN c_custkey % 103 = 0 THEN 7 ELSE 100 + c_nationkey END, 1,
               concat('/', r_name, '/', n_name, '/', c_name),
               CASE WHEN c_custkey % 107 = 0 THEN 'other' ELSE c_name END,
               CASE WHEN c_custkey % 50 = 0 THEN 'symlink' ELSE 'file' END,
               CASE WHEN c_custkey % 101 = 0 THEN 4 ELSE 3 END,
               CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'elf64'
                    WHEN 3 THEN 'ext4' WHEN 4 THEN 'squashfs' WHEN 5 THEN 'iso9660'
                    WHEN 6 THEN 'docker-tar' WHEN 7 THEN 'mbr-img' ELSE 'zip' END,
               c_custkey * 100,
               CASE WHEN c_custkey % 12 = 0 THEN 'unsupported' WHEN c_custkey % 12 = 1 THEN 'failed'
                    WHEN c_custkey % 12 = 2 THEN 'limit_reached' ELSE 'extracted' END,
               CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '[1]'
                    ELSE concat('{"block_size":', c_custkey,
                                ',"inodes":{"a":1},"blocks":"b","version":"4.0",',
                                '"partition_table":"mbr","sector_size":512,"x":true}') END,
               CASE WHEN c_custkey % 24 = 1 THEN 'bad_entry' ELSE '' END,
               CASE WHEN c_custkey % 24 = 0 THEN 'Not readable.' END,
               CASE WHEN c_custkey % 20 = 0 AND c_custkey > 10 THEN 990 + c_custkey END,
               TIMESTAMP '1999-01-01 00:00:00' + INTERVAL 1 HOUR * (c_custkey % 500)
        FROM customer JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey""",
    "blob_refs": f"""
        SELECT 1000 + c_custkey AS file_node_id, {_blob('c_custkey')} AS blob_id
        FROM customer WHERE c_custkey % 3 = 0""",
    "call_edges": """
        SELECT l_suppkey AS caller, l_partkey % 150 AS callee FROM lineitem""",
    "program_functions": "SELECT s_suppkey AS address, s_name AS name FROM supplier",
    "entry_points": "SELECT s_suppkey AS address FROM supplier WHERE s_suppkey % 10 = 0",
    "segments": """
        SELECT concat('seg', p_partkey % 400) AS name, p_partkey % 800 AS start_address,
               CASE WHEN p_partkey % 30 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(p_size AS BIGINT) END
                   AS size_bytes,
               CASE p_partkey % 5 WHEN 0 THEN 'r--' WHEN 1 THEN 'rwx' WHEN 2 THEN 'r-x'
                    WHEN 3 THEN 'xrw' ELSE 'rw' END AS permissions
        FROM part""",
    "fragments": """
        SELECT conv_id AS project_id, turn AS ordinal, concat('0x', turn) AS address, role AS name,
               CASE WHEN turn % 3 = 0 THEN concat(text, chr(10)) WHEN conv_id % 10 = 1 AND turn = 1
                    THEN '' ELSE text END AS body
        FROM conversations""",
    "worker_readiness": """
        SELECT s_name AS worker_owner,
               CASE s_suppkey % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'bytecode' ELSE 'scan' END
                   AS worker_kind,
               concat(' ', lower(r_name), ' ') AS analyzer_name,
               CASE WHEN r_regionkey = 1 AND s_suppkey % 2 = 0 THEN 'old' ELSE 'v1' END
                   AS analyzer_version,
               'jvm' AS runtime_name, '21' AS runtime_version,
               CASE WHEN s_acctbal < 0 THEN 'stopped' ELSE 'ready' END AS status,
               TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 SECOND * (s_suppkey * 7 % 90)
                   AS last_checked_at
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey""",
    "analyzer_registrations": """
        SELECT r_name AS name, 'v1' AS version, 'live' AS scope,
               CASE WHEN r_regionkey % 2 = 0 THEN 'native,bytecode' ELSE 'native,bytecode,cluster'
                    END AS required_kinds
        FROM region""",
    "storage_mounts": """
        SELECT concat('/mnt/', c_custkey) AS mount,
               CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 1000 + c_custkey END AS total_bytes,
               (c_custkey * 37) % 1000 AS free_bytes, 100 AS minimum_free_bytes
        FROM customer""",
    "manifest_declared": """
        SELECT doc_id % 20 AS bundle_id, concat('docs/', doc_id) AS path,
               octet_length(text) AS size_bytes, sha2(text, 256) AS sha256
        FROM documents""",
    "manifest_actual": """
        SELECT doc_id % 20 AS bundle_id,
               CASE WHEN doc_id % 47 = 0 THEN concat('extra/', doc_id)
                    ELSE concat('docs/', doc_id) END AS path,
               octet_length(text) + CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS size_bytes,
               CASE WHEN doc_id % 31 = 0 THEN sha2(lang, 256) ELSE sha2(text, 256) END AS sha256
        FROM documents""",
    "image_edges": """
        SELECT 'a' AS archive_id, concat('r-', n_regionkey) AS parent,
               concat('n-', n_nationkey) AS child, 'index' AS child_kind,
               CASE WHEN n_nationkey % 3 = 0 THEN concat('ref/', n_name) END AS reference
        FROM nation
        UNION ALL
        SELECT 'a', concat('n-', c_nationkey), concat('c-', c_custkey), 'index',
               CASE WHEN c_custkey % 5 = 0 THEN concat('ref/', c_custkey) END FROM customer
        UNION ALL
        SELECT 'a', concat('c-', o_custkey), concat('o-', o_orderkey), 'manifest',
               CASE WHEN o_orderkey % 9 = 0 THEN concat('ref/', o_orderkey) END FROM orders
        UNION ALL
        SELECT 'a', concat('c-', c_custkey), concat('n-', c_nationkey), 'index', NULL
        FROM customer WHERE c_custkey % 200 = 7""",
    "image_roots": "SELECT 'a' AS archive_id, concat('r-', r_regionkey) AS digest FROM region",
    "image_members": """
        SELECT concat('o-', l_orderkey) AS manifest, line_key AS digest, 'layer' AS kind
        FROM lines""",
    "image_descriptors": """
        SELECT 'a' AS archive_id, concat('c-', o_custkey) AS parent, concat('o-', o_orderkey) AS digest,
               CASE WHEN o_orderkey % 11 = 3 THEN 'unknown' WHEN o_orderkey % 4 = 1 THEN NULL
                    WHEN o_orderkey % 29 = 2 THEN 'windows' ELSE 'linux' END AS os,
               CASE WHEN o_orderkey % 11 = 3 THEN 'unknown' WHEN o_orderkey % 4 = 1 THEN NULL
                    WHEN o_orderkey % 2 = 0 THEN 'amd64' ELSE 'arm64' END AS architecture,
               CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 11 <> 3 THEN 'v8' WHEN o_orderkey % 55 = 3 THEN 'v1' END AS variant,
               CASE WHEN o_orderkey % 11 = 3 THEN 'attestation-manifest' END AS reference_type,
               CASE WHEN o_orderkey % 33 = 3 THEN concat('sha256:', o_orderkey)
                    WHEN o_orderkey % 11 = 3 THEN concat('sha256:', sha2(o_orderpriority, 256)) END AS reference_digest
        FROM orders""",
    "image_manifests": """
        SELECT concat('o-', o_orderkey) AS digest, concat('config-', o_orderkey) AS config FROM orders""",
    "image_configs": """
        SELECT concat('config-', o_orderkey) AS digest,
               CASE WHEN o_orderkey % 11 = 3 THEN 'unknown' WHEN o_orderkey % 37 = 0 THEN '' ELSE 'linux' END AS os,
               CASE WHEN o_orderkey % 11 = 3 THEN 'unknown' WHEN o_orderkey % 41 = 5 THEN 'arm 64'
                    WHEN o_orderkey % 2 = 0 THEN 'amd64' ELSE 'arm64' END AS architecture,
               CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 11 <> 3 AND o_orderkey % 13 <> 0 THEN 'v8' END AS variant
        FROM orders WHERE o_orderkey % 101 <> 7""",
    "image_layers": """
        SELECT concat('o-', l_orderkey) AS manifest, l_linenumber AS ordinal, line_key AS digest,
               CASE WHEN l_orderkey % 11 = 3 AND l_suppkey % 8 <> 0 THEN 'application/vnd.in-toto+json'
                    ELSE 'application/vnd.oci.image.layer.v1.tar+gzip' END AS media_type
        FROM lines""",
    "image_listing": """
        SELECT concat('o-', l_orderkey) AS manifest, line_key AS digest
        FROM lines WHERE l_suppkey % 25 <> 0""",
    "archive_entries": """
        SELECT l_orderkey AS archive_id, line_key AS entry_key,
               CASE WHEN l_partkey % 40 = 0 THEN 'AndroidManifest.xml'
                    WHEN l_partkey % 40 = 1 THEN 'WEB-INF/web.xml'
                    WHEN l_partkey % 40 = 2 THEN 'META-INF/application.xml'
                    WHEN l_partkey % 40 IN (3, 4, 5) THEN 'META-INF/MANIFEST.MF'
                    WHEN l_partkey % 40 IN (6, 7) THEN 'manifest.json'
                    WHEN l_partkey % 40 IN (8, 9, 10) THEN 'oci-layout'
                    WHEN l_partkey % 40 IN (11, 12, 13) THEN 'index.json'
                    WHEN l_partkey % 40 < 22 THEN
                         concat('META-INF/versions/', 7 + l_suppkey % 16, '/p/C',
                                l_linenumber % 2, '.class')
                    WHEN l_partkey % 40 = 22 THEN 'META-INF/versions/011/p/C1.class'
                    WHEN l_partkey % 40 = 23 THEN 'lib/x.so'
                    ELSE concat('p/C', l_linenumber % 2, '.class') END AS name,
               CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes
        FROM lines""",
    "archive_references": """
        SELECT l_orderkey AS archive_id, 'docker' AS kind,
               CASE WHEN l_suppkey % 4 = 0 THEN 'missing.json' ELSE 'p/C0.class' END AS name
        FROM lineitem WHERE l_partkey % 40 IN (6, 7)
        UNION ALL
        SELECT l_orderkey, 'oci',
               CASE WHEN l_suppkey % 4 = 0 THEN 'blobs/none' ELSE 'index.json' END
        FROM lineitem WHERE l_partkey % 40 IN (11, 12, 13)""",
    "extraction_entries": """
        SELECT l_suppkey AS task_id, l_suppkey * 10 + l_partkey % 3 AS container_id,
               l_orderkey AS ordinal, line_key AS entry_key,
               CAST(floor(l_extendedprice) AS BIGINT) AS expanded_bytes, l_linenumber AS depth,
               CAST(100000 + l_suppkey * 1000 AS BIGINT) AS root_size_bytes,
               CAST(20000 + l_partkey % 3 * 1000 AS BIGINT) AS container_size_bytes
        FROM lines""",
    "preview_nodes": """
        SELECT line_key AS node_key, l_orderkey AS archive_id,
               CASE WHEN l_suppkey % 50 = 0 THEN concat('/a//', l_partkey)
                    WHEN l_suppkey % 50 = 1 THEN concat('rel/', l_partkey)
                    WHEN l_suppkey % 50 = 2 THEN concat('/a/../', l_partkey)
                    ELSE concat('/a/', l_suppkey, '/', l_partkey) END AS logical_path,
               CASE WHEN l_partkey % 20 = 0 THEN 'directory' WHEN l_partkey % 20 = 1 THEN 'symlink'
                    WHEN l_partkey % 20 = 2 THEN 'hardlink' WHEN l_partkey % 20 = 3 THEN 'special'
                    ELSE 'file' END AS node_type,
               CASE l_suppkey % 11 WHEN 0 THEN 'password_required' WHEN 1 THEN 'invalid_path'
                    WHEN 2 THEN 'limit_exceeded' WHEN 3 THEN 'corrupt' WHEN 4 THEN 'unsupported'
                    WHEN 5 THEN 'cancelled' WHEN 6 THEN 'recorded' ELSE 'extracted' END
                   AS extraction_status,
               CASE WHEN l_linenumber = 1 AND l_suppkey % 11 = 1 THEN 'duplicate_logical_path'
                    WHEN l_linenumber = 1 AND l_suppkey % 11 = 2 THEN 'max_entry_bytes'
                    WHEN l_linenumber = 1 AND l_suppkey % 11 = 6 THEN 'odd_code'
                    WHEN l_linenumber = 7 THEN 'late_error' ELSE '' END AS error_code,
               l_suppkey % 13 = 0 AS is_wrapper,
               CASE l_partkey % 6 WHEN 0 THEN 'elf64' WHEN 1 THEN 'zip' WHEN 2 THEN 'docker-tar'
                    WHEN 3 THEN 'ext4' WHEN 4 THEN 'pe32' ELSE 'unknown' END AS format,
               CASE WHEN l_suppkey % 17 = 0 THEN '' ELSE concat('sha-', l_partkey) END AS sha256,
               CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes,
               l_suppkey % 19 <> 0 AS is_materialized
        FROM lines""",
    "blob_contents": """
        SELECT doc_id AS blob_id, sha2(text, 256) AS sha256, octet_length(text) AS size_bytes,
               unhex(CASE doc_id % 12 WHEN 0 THEN '7F454C4602' WHEN 1 THEN '4D5A9000'
                     WHEN 2 THEN '504B0304' WHEN 3 THEN 'CAFEBABE' WHEN 4 THEN '1F8B08'
                     WHEN 5 THEN '6465780A30333500' WHEN 6 THEN '6F0D0D0A'
                     WHEN 7 THEN 'FD377A585A00' WHEN 8 THEN '425A6839314159265359'
                     ELSE '' END) || CAST(text AS BINARY) AS content
        FROM documents""",
    "program_headers": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'pe' ELSE 'elf' END AS family,
               CAST(1 + p_size % 2 AS BIGINT) AS word_class,
               unhex(CASE p_partkey % 8 WHEN 0 THEN '4C01' WHEN 1 THEN '0300' WHEN 2 THEN '6486'
                     WHEN 3 THEN '0800' WHEN 4 THEN '64AA' WHEN 5 THEN 'F300' WHEN 6 THEN 'FFFF'
                     ELSE '3E00' END) AS machine,
               CASE p_partkey % 5 WHEN 0 THEN 3413 WHEN 1 THEN 62211 WHEN 2 THEN 3531
                    WHEN 3 THEN 1 ELSE 3627 END AS python_magic
        FROM part""",
    "report_documents": """
        SELECT line_key AS report_id,
               CASE WHEN l_partkey % 60 = 0 THEN '{"SchemaVersion":2,'
                    WHEN l_partkey % 60 = 1 THEN '{"SchemaVersion":2,"ArtifactName":"a","ArtifactType":"t","Results":[],"Odd":1}'
                    WHEN l_partkey % 60 = 2 THEN '{"SchemaVersion":2,"ArtifactName":"a","Results":[]}'
               ELSE concat(
                 '{"SchemaVersion":', CASE WHEN l_partkey % 60 = 3 THEN 1 ELSE 2 END,
                 ',"ArtifactName":"img', l_suppkey, CASE WHEN l_partkey % 60 = 4 THEN '\\u0001' ELSE '' END,
                 '","ArtifactType":"', CASE WHEN l_partkey % 60 = 5 THEN 'vm' ELSE 'container_image' END,
                 '"', CASE WHEN l_partkey % 60 IN (5, 6) THEN '}' ELSE concat(
                 ',"Results":[{"Target":"img', l_suppkey,
                 CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (debian 12)' ELSE ' ()' END,
                 '","Class":"os-pkgs","Type":"debian"',
                 CASE WHEN l_partkey % 60 = 7 THEN ',"Secrets":[1]' ELSE ',"Secrets":[]' END,
                 ',"Vulnerabilities":[{"VulnerabilityID":" CVE-', l_partkey,
                 ' ","PkgName":"pkg', l_partkey % 50, '","InstalledVersion":"1.', l_linenumber,
                 '","FixedVersion":"', CASE l_returnflag WHEN 'A' THEN '1.9' ELSE '  ' END,
                 '","Severity":"', CASE l_partkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'HIGH'
                      WHEN 2 THEN 'Critical' WHEN 3 THEN 'MEDIUM' ELSE 'UNKNOWN' END,
                 '","Title":" A\\n\\t title  ', l_partkey, ' ","PrimaryURL":"https://v.example/',
                 l_partkey, '","References":["https://v.example/', l_partkey,
                 '","ftp://no.example/x","http://r.example/a b","http://u:p@r.example/",',
                 '"https://r.example/', l_suppkey, '"],"DataSource":{"ID":"d","Name":"D",',
                 '"URL":"https://src.example"}},{"VulnerabilityID":"CVE-B', l_suppkey,
                 '","PkgName":"', CASE WHEN l_partkey % 60 = 8 THEN '' ELSE 'lib' END,
                 '","InstalledVersion":"2","Severity":"',
                 CASE WHEN l_partkey % 60 = 9 THEN 'SEVERE' ELSE 'LOW' END,
                 '"}]},{"Target":"app","Class":"lang-pkgs","Type":"jar"}]}') END) END AS document
        FROM lines""",
    "class_documents": """
        SELECT p_partkey AS class_id, concat(
                 '{"methods":[{"key":"m', p_partkey % 3, '","name":"a"},{"key":"m1","name":"b"},',
                 '{"key":"', CASE WHEN p_partkey % 4 = 0 THEN ' bad' ELSE 'm2' END,
                 '","name":"c"},{"key":"m', p_size % 5, '","name":"',
                 CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE 'd' END, '"}]}') AS diagnostics_json
        FROM part""",
    "checker_messages": """
        SELECT line_key AS id, CASE l_partkey % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'java' WHEN 2 THEN 'python'
                                    WHEN 3 THEN 'diagnostic' ELSE 'other' END AS checker,
               CASE l_suppkey % 9 WHEN 0 THEN 'cwe-78-command' WHEN 1 THEN 'java-weak-cipher'
                    WHEN 2 THEN 'python-insecure-request' WHEN 3 THEN 'syntax_error'
                    WHEN 4 THEN 'parser_no_ast' WHEN 5 THEN 'cwe-732-permissions' WHEN 6 THEN ''
                    WHEN 7 THEN 'cwe-000' ELSE 'java-insecure-cookie' END AS code,
               CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN concat(' line ', l_partkey, ' ')
                    WHEN 3 THEN '使用弱加密算法' ELSE l_returnflag END AS message
        FROM lines""",
    "evidence_documents": """
        SELECT line_key AS id, l_partkey AS k, l_partkey % 8 AS kind,
               CASE l_partkey % 8
               WHEN 0 THEN concat('{"b": 1.50, "a":"<x>&", "storage_key":"', l_partkey, '"}')
               WHEN 1 THEN concat('[{"Pass-Word":"p","n":12345678901234567890', l_partkey, '},null, true]')
               WHEN 2 THEN concat('{"a":', l_partkey)
               WHEN 3 THEN '{} {}'
               WHEN 4 THEN concat('{"k":{"API key":{"deep":1},"v":[1,2.0,1e5,', l_partkey, ']},"Secret":[]}')
               WHEN 5 THEN concat('"text é ', l_partkey, '"')
               WHEN 6 THEN ''
               ELSE concat('{"z":{},"y":[ ],"é":-0.10,"Z":', l_partkey, '}') END AS document
        FROM lines""",
    "source_files": """
        SELECT p_partkey AS file_id,
               CASE p_partkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'java' ELSE 'python' END AS language,
               concat('src/', p_brand, '/', p_partkey) AS logical_path,
               CASE p_partkey % 3
               WHEN 0 THEN concat(
                 'void f', p_partkey, '(char *s) {', chr(10), '  // gets(s);', chr(10),
                 CASE p_partkey % 4 WHEN 0 THEN '  gets(s);' WHEN 1 THEN '  printf(s);'
                      WHEN 2 THEN '  printf("%d", 1);' ELSE '  strcpy(s, "x"); system(cmd);' END,
                 chr(10), CASE p_size % 6 WHEN 0 THEN '  chmod(p, 0777);'
                      WHEN 1 THEN '  chmod(p, 0644);' WHEN 2 THEN '  MD5_Init(c);'
                      WHEN 3 THEN '  scanf("%s", s);' WHEN 4 THEN '  scanf("%10s", s);'
                      ELSE '  tmpnam(s);' END, chr(10), '} /* ', p_name, ' */', chr(10))
               WHEN 1 THEN concat(
                 'class C', p_partkey, ' {', chr(10), '  void m() {', chr(10),
                 CASE p_size % 6 WHEN 0 THEN '    MessageDigest.getInstance("MD5");'
                      WHEN 1 THEN '    MessageDigest.getInstance("SHA-256");'
                      WHEN 2 THEN '    Cipher.getInstance("AES/ECB/PKCS5Padding");'
                      WHEN 3 THEN '    SSLContext.getInstance("TLSv1.1");'
                      WHEN 4 THEN '    c.setSecure(false);'
                      ELSE '    f.setXIncludeAware(true);' END, chr(10), '  }', chr(10),
                 '} // ', p_name, chr(10))
               ELSE concat(
                 CASE p_size % 7 WHEN 0 THEN 'import pickle' WHEN 1 THEN 'import os'
                      WHEN 2 THEN 'from shelve import x' ELSE 'import hashlib' END, chr(10),
                 'def f(x):', chr(10),
                 CASE p_partkey % 5 WHEN 0 THEN '    return eval(x)'
                      WHEN 1 THEN '    os.system(x)' WHEN 2 THEN '    hashlib.md5(x)'
                      WHEN 3 THEN '    requests.get(x, verify=False)'
                      ELSE '    subprocess.Popen(x, shell=True)' END, chr(10),
                 '# ', p_name, ' eval(x)', chr(10)) END AS text
        FROM part""",
    "text_samples": """
        SELECT doc_id, text, lang, source FROM documents""",
}

_REFERENCE = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)", re.IGNORECASE)


def _needed(names: list[str]) -> list[str]:
    """Views in dependency order."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name not in VIEWS or name in out:
            return
        for other in _REFERENCE.findall(VIEWS[name]):
            if other != name:
                visit(other)
        out.append(name)

    for name in names:
        visit(name)
    return out


def _base_tables(sql: str) -> set[str]:
    return {name for name in _REFERENCE.findall(sql) if name in schemas.TABLE_SCHEMAS}


def view_sql(name: str) -> str:
    needed = _needed([name])
    head = ",\n".join(f"{view} AS ({VIEWS[view]})" for view in needed)
    return f"WITH {head}\nSELECT * FROM {name}"


def check_sql(body: str) -> str:
    """The body prefixed by the views it names, in the checking database's words."""
    names = [name for name in re.findall(r"\b[a-z_]+\b", body) if name in VIEWS]
    needed = _needed(names)
    parts = [f"{view} AS ({VIEWS[view]})" for view in needed]
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        text = "WITH RECURSIVE " + ",\n".join([*parts, stripped[len("WITH RECURSIVE "):]])
    elif stripped.upper().startswith("WITH "):
        text = "WITH " + ",\n".join([*parts, stripped[len("WITH "):]])
    elif parts:
        text = "WITH " + ",\n".join(parts) + "\n" + stripped
    else:
        text = stripped
    text = re.sub(r"sha2\(([a-z_]+), 256\)", r"sha256(\1)", text)
    text = text.replace("octet_length(", "strlen(")
    return re.sub(r"CAST\(([a-z_]+) AS BINARY\)", r"encode(\1)", text)


class Domain:
    """Domain tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = apply_settings(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return scan_table(self.spark, self.folder, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in schemas.TABLE_SCHEMAS:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        sql = view_sql(name).replace("\\", "\\\\")  # backslashes are plain text in the views
        for table in sorted(_base_tables(sql)):
            # an own view name, so no view of the session is replaced
            self.table(table).createOrReplaceTempView(f"cairnlens_{table}")
            sql = re.sub(rf"\b(FROM|JOIN)(\s+){table}\b", rf"\1\2cairnlens_{table}", sql)
        return self.spark.sql(sql)
