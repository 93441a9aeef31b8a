"""Queries: report normalisation, methods, payloads and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlens.functions import text
from cairnlens.functions.predicates import blank_to
from cairnlens.operators import nested
from cairnlens.plans.registry import query

# report rejection, written on the JSON text with the checking database's functions
REASON = """
SELECT report_id, document, CASE
  WHEN NOT json_valid(document) THEN 'not_json'
  WHEN list_contains(json_keys(document), 'Odd') THEN 'unknown_field'
  WHEN NOT list_contains(json_keys(document), 'ArtifactType') THEN 'missing_field'
  WHEN json_extract_string(document, '$.ArtifactType') <> 'vm'
       AND NOT list_contains(json_keys(document), 'Results') THEN 'missing_results'
  WHEN json_extract_string(document, '$.SchemaVersion') <> '2' THEN 'schema_version'
  WHEN regexp_matches(json_extract_string(document, '$.ArtifactName'), '[\\x00-\\x1F\\x7F]')
    THEN 'artifact_name'
  WHEN json_extract(document, '$.Results[0].Secrets') <> '[]' THEN 'disabled_scanner'
  WHEN list_contains(json_extract_string(document, '$.Results[*].Vulnerabilities[*].PkgName'), '')
    THEN 'package_name'
  WHEN list_contains(json_extract_string(document, '$.Results[*].Vulnerabilities[*].Severity'),
                     'SEVERE') THEN 'severity' END AS reason
FROM report_documents"""


@query("report_quality", f"SELECT report_id, reason FROM ({REASON}) WHERE reason IS NOT NULL")
def _(d):
    return nested.rejected_reports(d.report_documents).select("report_id", "reason")


EXPLODED = f"""
SELECT report_id, document, i.i AS result_index, j.j AS finding_index,
       json_extract(document, concat('$.Results[', i.i, '].Vulnerabilities[', j.j, ']')) AS v,
       json_extract_string(document, '$.ArtifactName') AS artifact,
       json_extract_string(document, concat('$.Results[', i.i, '].Target')) AS target,
       json_extract_string(document, concat('$.Results[', i.i, '].Class')) AS class,
       json_extract_string(document, concat('$.Results[', i.i, '].Type')) AS type
FROM ({REASON}) r, (VALUES (0), (1)) AS i(i), (VALUES (0), (1)) AS j(j)
WHERE reason IS NULL
  AND json_extract(document, concat('$.Results[', i.i, '].Vulnerabilities[', j.j, ']')) IS NOT NULL"""
TARGET = """CASE WHEN target = artifact THEN 'container image'
  WHEN NOT starts_with(target, concat(artifact, ' ')) THEN target
  WHEN trim(substr(target, length(artifact) + 1)) = '()' THEN '()'
  ELSE regexp_extract(target, '\\((.*)\\)$', 1) END"""


@query("explode_findings", f"""
SELECT report_id, result_index, finding_index,
       trim(json_extract_string(v, '$.VulnerabilityID')) AS vulnerability_id,
       upper(json_extract_string(v, '$.Severity')) AS severity,
       json_extract_string(v, '$.PkgName') AS package_name,
       json_extract_string(v, '$.InstalledVersion') AS installed_version,
       trim(COALESCE(json_extract_string(v, '$.FixedVersion'), '')) AS fixed_version,
       trim(regexp_replace(COALESCE(json_extract_string(v, '$.Title'), ''), '\\s+', ' ', 'g'))
         AS title, {TARGET} AS target, class, type
FROM ({EXPLODED})""")
def _(d):
    return nested.explode_findings(nested.accepted_reports(d.report_documents)).select(
        "report_id", "result_index", "finding_index", "vulnerability_id", "severity",
        "package_name", "installed_version", "fixed_version", "title", "target", "class", "type",
    )


@query("merge_references", f"""
SELECT report_id, result_index, finding_index, CASE WHEN finding_index = 1 THEN '' ELSE
  concat(json_extract_string(v, '$.PrimaryURL'), '|', json_extract_string(v, '$.References[4]'),
         '|https://src.example') END AS joined
FROM ({EXPLODED})""")
def _(d):
    rows = nested.explode_findings(nested.accepted_reports(d.report_documents))
    return rows.select(
        "report_id", "result_index", "finding_index", F.array_join("references", "|").alias("joined")
    )


@query("normalize_target", f"SELECT report_id, {TARGET} AS target FROM ({EXPLODED})")
def _(d):
    rows = nested.explode_findings(nested.accepted_reports(d.report_documents))
    return rows.select("report_id", "target")


@query("evidence_struct", f"""
SELECT report_id, result_index, finding_index,
  concat('{{"package_name":"', json_extract_string(v, '$.PkgName'), '","installed_version":"',
    json_extract_string(v, '$.InstalledVersion'), '"',
    CASE WHEN trim(COALESCE(json_extract_string(v, '$.FixedVersion'), '')) = '' THEN ''
         ELSE concat(',"fixed_version":"', json_extract_string(v, '$.FixedVersion'), '"') END,
    ',"target":"', {TARGET}, '","class":"', class, '","type":"', type, '","image_references":[',
    CASE WHEN finding_index = 1 THEN ']' ELSE concat('"', json_extract_string(v, '$.PrimaryURL'),
      '","', json_extract_string(v, '$.References[4]'), '","https://src.example"],',
      '"data_source":{{"id":"d","name":"D","url":"https://src.example"}}') END, '}}')
  AS evidence_json
FROM ({EXPLODED})""")
def _(d):
    rows = nested.explode_findings(nested.accepted_reports(d.report_documents))
    return nested.evidence(rows).select(
        "report_id", "result_index", "finding_index", "evidence_json"
    )


PAYLOAD_TIME = "strftime({0}, '%Y-%m-%dT%H:%M:%S.000Z')"


def _json_or_null(column, quoted=True):
    value = f"concat('\"', {column}, '\"')" if quoted else f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN 'null' ELSE {value} END"


@query("event_payload", f"""
SELECT id, concat('{{"status":"', status, '","stage":"', stage, '","progress_basis_points":',
  progress_basis_points, ',"risk_level":"', risk_level, '","error_code":',
  {_json_or_null('error_code')}, ',"error_message":', {_json_or_null('error_message')},
  ',"sample_expires_at":', {_json_or_null(PAYLOAD_TIME.format('sample_expires_at'))},
  ',"sample_deleted_at":', {_json_or_null(PAYLOAD_TIME.format('sample_deleted_at'))},
  ',"deleted_at":', {_json_or_null(PAYLOAD_TIME.format('deleted_at'))}, '}}') AS payload
FROM tasks""")
def _(d):
    return nested.event_payload(d.tasks).select("id", "payload")


METHODS = """
SELECT class_id, pos AS position,
  json_extract_string(diagnostics_json, concat('$.methods[', pos, '].key')) AS method_key,
  json_extract_string(diagnostics_json, concat('$.methods[', pos, '].name')) AS name
FROM class_documents, (VALUES (0), (1), (2), (3)) AS p(pos)"""
VALID_METHOD = "regexp_matches(method_key, '^[A-Za-z0-9][A-Za-z0-9._:/@+$-]*$') AND trim(name) <> ''"


@query("method_index", f"""
SELECT class_id, position, method_key, name FROM ({METHODS}) WHERE {VALID_METHOD}
QUALIFY row_number() OVER (PARTITION BY class_id, method_key ORDER BY position) = 1""")
def _(d):
    return nested.method_index(d.class_documents, "class_id")


@query("method_counts", f"""
SELECT class_id, 4 AS declared_count, count(DISTINCT method_key) FILTER ({VALID_METHOD})
         AS kept_count, 4 - count(DISTINCT method_key) FILTER ({VALID_METHOD}) AS invalid_count,
       0 AS omitted_count
FROM ({METHODS}) GROUP BY class_id""")
def _(d):
    return nested.method_counts(d.class_documents, "class_id")


@query("display_symbol", """
SELECT id, CASE WHEN json_extract_string(diagnostics_json, '$.symbol_kind') = 'Function'
         THEN 'function' WHEN json_extract_string(diagnostics_json, '$.symbol_kind') = 'odd'
         THEN 'unknown' ELSE 'method' END AS symbol_kind,
       json_extract_string(diagnostics_json, '$.symbol.name') AS display_name,
       json_extract_string(diagnostics_json, '$.location') AS location
FROM decompile_results""")
def _(d):
    return nested.symbol_labels(d.decompile_results)


@query("safe_json", """
SELECT report_id, CASE WHEN json_valid(document) THEN document END AS document
FROM report_documents""")
def _(d):
    return d.report_documents.select("report_id", text.safe_json("document").alias("document"))


# --- scalar functions over whole texts ---------------------------------------------
SPACES = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("normalize_display_text", rf"""
WITH shaped AS (SELECT doc_id, regexp_replace(text, '^{SPACES}+|{SPACES}+$', '', 'g') AS t
                FROM text_samples),
lines1 AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN NULL
           ELSE regexp_replace(t, '{SPACES}+', ' ', 'g') END AS t FROM shaped)
SELECT doc_id, CASE WHEN strlen(t) <= 256 THEN t ELSE concat(rtrim(left(t,
  list_max(list_filter(range(0, 254), lambda k: strlen(left(t, k)) <= 253)))), '...') END AS shown
FROM lines1""")
def _(d):
    return d.text_samples.select("doc_id", text.display_text("text", 256).alias("shown"))


@query("safe_display_text", r"""
SELECT doc_id, sha256(regexp_replace(text, '[\p{Cc}\p{Cf}\x{2028}\x{2029}]', '�', 'g'))
  AS shown_sha256 FROM text_samples""")
def _(d):
    return d.text_samples.select("doc_id", F.sha2(text.safe_display("text"), 256).alias("shown_sha256"))


@query("valid_text", rf"""
SELECT doc_id, regexp_replace(text, '{SPACES}+', '', 'g') <> '' AND strlen(text) <= 2000
  AND NOT regexp_matches(text, '[\x00-\x1F\x7F]') AS is_valid FROM text_samples""")
def _(d):
    return d.text_samples.select("doc_id", text.valid_text("text", 2000).alias("is_valid"))


@query("normalize_http_url", r"""
SELECT page_id, link, CASE WHEN regexp_matches(link, '^https?://[^/?#@:]+(:[0-9]*)?([/?#].*)?$')
  AND NOT regexp_matches(link, '[\x00-\x20\x7F]')
  AND NOT regexp_matches(regexp_extract(link, '^([^?]*)', 1),
      '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)')
  THEN link ELSE '' END AS usable
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)""")
def _(d):
    links = d.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    return links.select("page_id", "link", text.http_url("link").alias("usable"))


@query("relative_logical_path", r"""
SELECT node_key, CASE WHEN starts_with(logical_path, '/') AND logical_path <> '/'
  AND NOT regexp_matches(logical_path, '//|/$|(^|/)\.{1,2}(/|$)')
  THEN substr(logical_path, 2) END AS relative_path FROM preview_nodes""")
def _(d):
    return d.preview_nodes.select("node_key", text.relative_path("logical_path").alias("relative_path"))


@query("java_source_path", r"""
SELECT logical_path, count(*) AS n,
  starts_with(logical_path, 'src/main/java/') AND lower(logical_path) LIKE '%.java' AS is_java
FROM (SELECT logical_path FROM rule_findings UNION ALL SELECT logical_path FROM source_files)
GROUP BY logical_path""")
def _(d):
    paths = d.rule_findings.select("logical_path").unionByName(d.source_files.select("logical_path"))
    return paths.groupBy("logical_path").agg(F.count("*").alias("n")).withColumn(
        "is_java", text.java_source_path("logical_path")
    )


@query("archive_task_name", """
WITH named AS (SELECT doc_id, replace(text, chr(10), ' ') AS entry, concat(source, '-', lang,
                 CASE WHEN doc_id % 2 = 0 THEN left(replace(text, chr(10), ' '), 90) ELSE '' END)
                 AS archive FROM text_samples),
cut AS (SELECT *, CASE WHEN length(archive) > 80 THEN concat(left(archive, 77), '...')
                       ELSE archive END AS a FROM named)
SELECT doc_id, CASE WHEN length(archive) + 4 + length(entry) <= 255
    THEN concat(archive, ' :: ', entry)
  ELSE concat(a, ' :: ', CASE WHEN length(entry) > 251 - length(a)
    THEN concat('...', right(entry, 248 - length(a))) ELSE entry END) END AS task_name
FROM cut""")
def _(d):
    entry = F.replace("text", F.lit("\n"), F.lit(" "))
    archive = F.concat(
        "source", F.lit("-"), "lang",
        F.when(F.col("doc_id") % 2 == 0, F.left(entry, F.lit(90))).otherwise(""),
    )
    return d.text_samples.select("doc_id", text.archive_task_name(archive, entry).alias("task_name"))


@query("stable_key", """
SELECT o_orderkey AS id,
  concat('run:', sha256(concat(strlen(o_orderpriority), ':', o_orderpriority,
         length(CAST(o_orderkey AS VARCHAR)), ':', o_orderkey))) AS stable_key,
  concat('sha256:', sha256(concat(o_orderpriority, chr(0), o_orderkey))) AS joined_key
FROM orders""")
def _(d):
    return d.orders.select(
        F.col("o_orderkey").alias("id"),
        text.stable_key("run", "o_orderpriority", "o_orderkey").alias("stable_key"),
        text.joined_key("o_orderpriority", "o_orderkey").alias("joined_key"),
    )


@query("storage_key", """
SELECT id, concat('blobs/sha256/', left(sha256, 2), '/', sha256) AS storage_key FROM blobs""")
def _(d):
    return d.blobs.select("id", text.storage_key("sha256").alias("storage_key"))


@query("line_count", r"""
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE
    length(text) - length(replace(text, chr(10), '')) +
    CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END AS line_span,
  CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '\r\n|\r|\n')) +
    CASE WHEN right(text, 1) IN (chr(10), chr(13)) THEN 0 ELSE 1 END END AS line_count
FROM text_samples""")
def _(d):
    return d.text_samples.select(
        "doc_id", text.line_span("text").alias("line_span"), text.line_count("text").alias("line_count")
    )


@query("weighted_progress", """
SELECT id, CASE WHEN upper(stage) NOT IN ('EXTRACTING', 'SCANNING', 'REPORTING') THEN NULL
    WHEN id % 10 = 0 THEN CASE upper(stage) WHEN 'EXTRACTING' THEN 1500 WHEN 'SCANNING' THEN 7000
         ELSE 9500 END
    WHEN progress_basis_points <= 10000 THEN CASE upper(stage)
      WHEN 'EXTRACTING' THEN 1500 + 4000 * progress_basis_points // 10000
      WHEN 'SCANNING' THEN 7000 + 2500 * progress_basis_points // 10000
      ELSE 9500 + 500 * progress_basis_points // 10000 END END AS overall_points,
  CASE WHEN upper(stage) IN ('EXTRACTING', 'SCANNING', 'REPORTING')
       THEN id % 10 = 0 AND upper(stage) <> 'REPORTING' END AS indeterminate
FROM tasks""")
def _(d):
    local = F.when(F.col("id") % 10 != 0, F.col("progress_basis_points"))
    points, unknown = text.weighted_progress("stage", local)
    return d.tasks.select("id", points.alias("overall_points"), unknown.alias("indeterminate"))


@query("progress_percent", "SELECT id, progress_basis_points / 100.0::DOUBLE AS percent FROM tasks")
def _(d):
    return d.tasks.select("id", text.progress_percent("progress_basis_points").cast("double").alias("percent"))


@query("duration_ms", """
SELECT analyzer_name, CAST(round(sum(epoch_us(completed_at) - epoch_us(created_at))::DECIMAL(38,6)
         / count(*) / 1000) AS BIGINT) AS mean_ms
FROM analyzer_runs WHERE completed_at IS NOT NULL GROUP BY analyzer_name""")
def _(d):
    done = d.analyzer_runs.filter("completed_at IS NOT NULL")
    return done.groupBy("analyzer_name").agg(
        text.mean_millis(text.micros_between("created_at", "completed_at")).alias("mean_ms")
    )


@query("compression_ratio_exceeded", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN floor(l_extendedprice) = 0 THEN false
  WHEN l_suppkey % 30 = 0 THEN true
  ELSE CAST(floor(l_extendedprice) AS HUGEINT) > (l_suppkey % 30) * 50 * 50 END AS exceeded
FROM lineitem""")
def _(d):
    return d.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        text.ratio_exceeded(
            F.floor("l_extendedprice").cast("bigint"), (F.col("l_suppkey") % 30) * 50, 50
        ).alias("exceeded"),
    )


@query("machine_name", """
SELECT id, family, CASE WHEN family = 'pe' THEN CASE hex(machine) WHEN '4C01' THEN 'x86'
    WHEN '6486' THEN 'x86_64' WHEN '64AA' THEN 'arm64' ELSE '' END
  ELSE CASE hex(machine) WHEN '0300' THEN 'x86' WHEN '3E00' THEN 'x86_64'
    WHEN '0800' THEN CASE word_class WHEN 2 THEN 'mips64' ELSE 'mips' END
    WHEN 'F300' THEN CASE word_class WHEN 2 THEN 'riscv64' ELSE 'riscv32' END ELSE '' END END
  AS architecture
FROM program_headers""")
def _(d):
    from cairnlens.operators.classify import machine_names

    return machine_names(d.program_headers).select("id", "family", "architecture")


@query("python_bytecode_version", """
SELECT id, CASE python_magic WHEN 3413 THEN '3.8' WHEN 62211 THEN '2.7' WHEN 3531 THEN '3.12'
         WHEN 3627 THEN '3.14' END AS python_version,
       CASE python_magic WHEN 62211 THEN 8 WHEN 1 THEN NULL ELSE 16 END AS header_size
FROM program_headers""")
def _(d):
    from cairnlens.operators.classify import python_versions

    return python_versions(d.program_headers).select("id", "python_version", "header_size")


@query("blank_defaults", """
SELECT id, COALESCE(NULLIF(error_code, ''), 'analyzer_failed') AS code,
       COALESCE(NULLIF(error_message, ''), 'Analyzer execution failed.') AS message
FROM analyzer_runs""")
def _(d):
    return d.analyzer_runs.select(
        "id", blank_to("error_code", "analyzer_failed").alias("code"),
        blank_to("error_message", "Analyzer execution failed.").alias("message"),
    )


@query("bounded_strings", """
SELECT conv_id, turn, array_to_string(list_filter(parts, lambda x, i:
         i = list_position(parts, x))[:20], '|') AS kept
FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)),
        lambda x: x <> '' AND strlen(x) <= 12 AND NOT regexp_matches(x, '[\\x00-\\x1F\\x7F]'))
        AS parts FROM conversations)""")
def _(d):
    words = F.split("text", " ")
    return d.conversations.select(
        "conv_id", "turn", F.array_join(text.bounded_strings(words, 20, 12), "|").alias("kept")
    )


@query("readable_target", """
SELECT report_id, target, CASE WHEN target LIKE '% (%)' AND trim(regexp_extract(target,
         '^.* [(](.*)[)]$', 1)) <> '' THEN trim(regexp_extract(target, '^.* [(](.*)[)]$', 1))
       ELSE target END AS shown
FROM (SELECT report_id, json_extract_string(CASE WHEN json_valid(document) THEN document END,
        '$.Results[0].Target') AS target FROM report_documents) WHERE target IS NOT NULL""")
def _(d):
    targets = d.report_documents.select(
        "report_id", F.get_json_object("document", "$.Results[0].Target").alias("target")
    )
    shown = targets.select("report_id", "target", text.readable_target("target").alias("shown"))
    return shown.filter("target IS NOT NULL")
