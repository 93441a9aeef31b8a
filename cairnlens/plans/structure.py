"""Queries: ranges, graphs, trees, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlens.operators import classify, graph, images, ranges
from cairnlens.plans.registry import query


@query("canonical_offsets", """
WITH sized AS (SELECT *, row_number() OVER w AS k,
    CASE WHEN right(body, 1) = chr(10) THEN 1 ELSE 2 END AS sep,
    length(body) - length(replace(body, chr(10), '')) AS nl FROM fragments
  WINDOW w AS (PARTITION BY project_id ORDER BY ordinal)),
banners AS (SELECT *, strlen(concat('/* function ', lpad(CAST(k AS VARCHAR), 6, '0'),
    ' | address ', address, ' | name ', name, ' */', chr(10))) AS banner FROM sized),
placed AS (SELECT *,
    strlen(concat('/* Pseudo-C project ', project_id,
                  '. Not original buildable C source. */', chr(10), chr(10)))
      + COALESCE(sum(banner + strlen(body) + sep) OVER p, 0) + banner AS offset_bytes,
    3 + COALESCE(sum(nl + 1 + sep) OVER p, 0) + 1 AS start_line FROM banners
  WINDOW p AS (PARTITION BY project_id ORDER BY ordinal
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT project_id, ordinal, offset_bytes::BIGINT AS offset_bytes, strlen(body) AS length_bytes,
       start_line::BIGINT AS start_line,
       (start_line - 1 + CASE WHEN body = '' THEN 0 ELSE nl + CASE WHEN sep = 1 THEN 0 ELSE 1 END
        END)::BIGINT AS end_line
FROM placed""")
def _(d):
    return ranges.canonical_offsets(d.fragments)


@query("range_overlaps", """
SELECT project_id, result_id, COALESCE(e > offset_bytes, false) AS bytes_overlap,
       COALESCE(l >= start_line, false) AS lines_overlap
FROM (SELECT *, max(offset_bytes + length_bytes) OVER w AS e, max(end_line) OVER w AS l
      FROM project_functions WINDOW w AS (PARTITION BY project_id ORDER BY offset_bytes, result_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE COALESCE(e > offset_bytes, false) OR COALESCE(l >= start_line, false)""")
def _(d):
    return ranges.range_overlaps(d.project_functions).select(
        "project_id", "result_id", "bytes_overlap", "lines_overlap"
    )


@query("extraction_budget", """
WITH c AS (SELECT *, COALESCE(sum(expanded_bytes) OVER (PARTITION BY task_id, container_id
    ORDER BY ordinal, entry_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb
  FROM extraction_entries),
g AS (SELECT *, greatest(container_size_bytes * 50 - cb, 0) AS cl FROM c),
t AS (SELECT *, COALESCE(sum(least(expanded_bytes, cl)) OVER w, 0) AS tb,
    COALESCE(count(*) OVER w, 0) AS nb FROM g WINDOW w AS (PARTITION BY task_id
    ORDER BY ordinal, entry_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, greatest(6000000 - tb, 0) AS tl, greatest(root_size_bytes * 50 - tb, 0) AS rl FROM t)
SELECT task_id, container_id, entry_key, least(expanded_bytes, tl, rl, cl)::BIGINT AS allowed_bytes,
  CASE WHEN depth > 6 THEN 'max_depth' WHEN nb >= 400 THEN 'max_nodes'
       WHEN expanded_bytes <= least(tl, rl, cl) THEN NULL
       WHEN tl <= least(rl, cl) THEN 'max_expanded_bytes' ELSE 'max_ratio' END AS limit_code,
  tb > least(6000000, root_size_bytes * 50) OR nb > 400 AS after_stop
FROM f""")
def _(d):
    return ranges.extraction_budget(
        d.extraction_entries, max_expanded=6_000_000, max_nodes=400
    ).select("task_id", "container_id", "entry_key", "allowed_bytes", "limit_code", "after_stop")


@query("call_edges", "SELECT DISTINCT caller, callee FROM call_edges ORDER BY caller, callee")
def _(d):
    return graph.call_edges(d.call_edges)


@query("outgoing_calls", """
SELECT f.address, f.name, f.address IN (SELECT address FROM entry_points) AS is_entry_point,
       e.callee, CASE WHEN e.callee IS NOT NULL
         THEN e.callee NOT IN (SELECT address FROM program_functions) END AS external
FROM program_functions f LEFT JOIN (SELECT DISTINCT caller, callee FROM call_edges) e
  ON e.caller = f.address""")
def _(d):
    return graph.outgoing_calls(d.program_functions, d.call_edges, d.entry_points)


@query("call_totals", """
SELECT f.address, count(DISTINCT e.callee) AS outgoing_calls,
       f.address IN (SELECT address FROM entry_points) AS is_entry_point
FROM program_functions f LEFT JOIN call_edges e ON e.caller = f.address GROUP BY f.address""")
def _(d):
    return graph.call_totals(d.program_functions, d.call_edges, d.entry_points)


@query("call_graph_check", """
SELECT 'unknown_caller' AS violation, CAST(callee AS VARCHAR) AS item, count(*) AS row_count
FROM call_edges WHERE callee NOT IN (SELECT address FROM program_functions) GROUP BY callee
UNION ALL SELECT 'duplicate_edge', concat(callee, '/', caller), count(*) FROM call_edges
GROUP BY caller, callee HAVING count(*) > 1
UNION ALL SELECT 'duplicate_segment', concat(name, '/', start_address), count(*) FROM segments
GROUP BY name, start_address HAVING count(*) > 1""")
def _(d):
    # edges read backwards, so that some callers are unknown
    turned = d.call_edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    return graph.call_graph_check(d.program_functions, turned, d.segments, d.entry_points)


@query("segment_violations", """
SELECT name, start_address, 'permissions' AS violation FROM segments
WHERE NOT regexp_full_match(permissions, '[r-][w-][x-]')
UNION ALL SELECT name, start_address, 'size' FROM segments WHERE size_bytes = 0""")
def _(d):
    return graph.segment_violations(d.segments)


CONTAINERS = "('docker-tar', 'ext4', 'mbr-img', 'zip', 'squashfs', 'iso9660')"
TREE = """SELECT n.*, p.id AS p_id, p.depth AS p_depth, p.logical_path AS p_path,
  p.node_type AS p_type, s.id AS s_id, s.node_type AS s_type, s.format AS s_format,
  CASE WHEN regexp_extract(n.logical_path, '^(.*)/[^/]*$', 1) = '' THEN '/'
       ELSE regexp_extract(n.logical_path, '^(.*)/[^/]*$', 1) END AS dir
FROM file_nodes n LEFT JOIN file_nodes p ON p.task_id = n.task_id AND p.id = n.parent_id
LEFT JOIN file_nodes s ON s.task_id = n.task_id AND s.id = n.source_container_id"""


@query("tree_integrity", f"""
WITH tree AS ({TREE})
SELECT task_id, id, 'parent_missing' AS violation FROM tree
WHERE parent_id IS NOT NULL AND (p_id IS NULL OR parent_id >= id)
UNION ALL SELECT task_id, id, 'depth' FROM tree WHERE depth <> p_depth + 1
UNION ALL SELECT task_id, id, 'path' FROM tree WHERE dir <> p_path
UNION ALL SELECT task_id, id, 'root_depth' FROM tree WHERE parent_id IS NULL AND depth <> 1
UNION ALL SELECT task_id, id, 'root_path' FROM tree WHERE parent_id IS NULL AND dir <> '/'
UNION ALL SELECT task_id, id, 'parent_type' FROM tree
WHERE p_type IN ('symlink', 'hardlink', 'special')
UNION ALL SELECT task_id, id, 'display_name' FROM tree
WHERE display_name <> string_split(logical_path, '/')[-1]
UNION ALL SELECT task_id, id, 'source_missing' FROM tree
WHERE source_container_id IS NOT NULL AND (s_id IS NULL OR source_container_id >= id)
UNION ALL SELECT task_id, id, 'source_type' FROM tree WHERE s_type <> 'file'
UNION ALL SELECT task_id, id, 'source_format' FROM tree
WHERE s_type = 'file' AND COALESCE(s_format, '') NOT IN {CONTAINERS}""")
def _(d):
    return graph.tree_integrity(d.file_nodes)


# Ways from the roots, each node once for every reference; then pairs of indexes that
# lead to each other, and longest ways that touch no cycle.
WALK = """
WITH RECURSIVE walk AS (
  SELECT e.archive_id, e.child AS digest, e.child_kind AS kind, e.reference
  FROM image_edges e JOIN image_roots r ON r.archive_id = e.archive_id AND r.digest = e.parent
  UNION
  SELECT e.archive_id, e.child, e.child_kind, COALESCE(e.reference, w.reference)
  FROM walk w JOIN image_edges e ON e.archive_id = w.archive_id AND e.parent = w.digest
  WHERE w.kind = 'index'
), reachable AS (
  SELECT archive_id, digest FROM image_roots UNION SELECT archive_id, digest FROM walk WHERE kind = 'index'
), live AS (
  SELECT e.archive_id, e.parent, e.child, e.child_kind FROM image_edges e
  JOIN reachable r ON r.archive_id = e.archive_id AND r.digest = e.parent
)"""
CLOSURE = f"""{WALK}, pairs AS (
  SELECT archive_id, parent, child FROM live WHERE child_kind = 'index'
  UNION
  SELECT p.archive_id, p.parent, l.child FROM pairs p
  JOIN live l ON l.archive_id = p.archive_id AND l.parent = p.child WHERE l.child_kind = 'index'
), turning AS (SELECT archive_id, parent AS digest FROM pairs WHERE parent = child),
behind AS (
  SELECT archive_id, digest FROM turning
  UNION SELECT p.archive_id, p.child FROM pairs p JOIN turning t ON t.archive_id = p.archive_id AND t.digest = p.parent
), ways AS (
  SELECT r.archive_id, r.digest, 0 AS layer FROM image_roots r
  UNION
  SELECT w.archive_id, l.child, w.layer + 1 FROM ways w
  JOIN live l ON l.archive_id = w.archive_id AND l.parent = w.digest AND l.child_kind = 'index'
  WHERE NOT EXISTS (SELECT 1 FROM behind b WHERE b.archive_id = l.archive_id AND b.digest = l.child)
), steps AS (
  SELECT r.archive_id, r.digest, 'index' AS kind, -1 AS depth FROM image_roots r
  UNION
  SELECT l.archive_id, l.child, l.child_kind, s.depth + 1 FROM steps s
  JOIN live l ON l.archive_id = s.archive_id AND l.parent = s.digest
  WHERE s.kind = 'index' AND s.depth < (SELECT count(*) FROM image_roots) + 30
), layers AS (SELECT archive_id, digest, max(layer) AS layer FROM ways GROUP BY ALL)"""


@query("image_index_closure", f"""{CLOSURE}, facts AS (
  SELECT l.archive_id, l.child AS digest, l.child_kind AS kind, max(y.layer) AS layer, count(b.digest) > 0 AS behind_cycle
  FROM live l LEFT JOIN layers y ON y.archive_id = l.archive_id AND y.digest = l.parent
  LEFT JOIN behind b ON b.archive_id = l.archive_id AND b.digest = l.parent GROUP BY 1, 2, 3
)
SELECT f.archive_id, f.digest, f.kind, n.depth, CASE WHEN NOT behind_cycle THEN layer END AS deepest, behind_cycle,
       behind_cycle OR layer > 8 AS too_deep
FROM facts f JOIN (SELECT archive_id, digest, kind, min(depth) AS depth FROM steps WHERE depth >= 0 GROUP BY 1, 2, 3) n
  ON n.archive_id = f.archive_id AND n.digest = f.digest AND n.kind = f.kind""")
def _(d):
    return images.image_index_closure(d.image_roots, d.image_edges)


@query("image_targets", f"""{WALK}
SELECT DISTINCT archive_id, digest, COALESCE(reference, digest) AS reference FROM walk WHERE kind = 'manifest'""")
def _(d):
    return images.image_targets(images.image_walk(d.image_roots, d.image_edges))


PLATFORM = "^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"
CHECKED = f"""{WALK}, held AS (
  SELECT manifest, count(*) AS layer_count, bool_and(media_type = 'application/vnd.in-toto+json') AS attested
  FROM image_layers GROUP BY manifest
), checked AS (
  SELECT d.archive_id, d.parent, d.digest, CASE WHEN d.reference_type = 'attestation-manifest' THEN 'attestation' ELSE 'image' END AS role,
         c.os, c.architecture, c.variant, COALESCE(h.layer_count, 0) AS layer_count,
         CASE WHEN d.reference_type = 'attestation-manifest' THEN
                CASE WHEN regexp_full_match(d.reference_digest, 'sha256:[a-f0-9]{{64}}') AND d.os = 'unknown' AND d.architecture = 'unknown'
                      AND d.variant IS NULL AND c.os = 'unknown' AND c.architecture = 'unknown' AND COALESCE(c.variant, '') = ''
                      AND h.attested THEN NULL ELSE 'attestation_invalid' END
              WHEN NOT COALESCE(regexp_matches(c.os, '{PLATFORM}') AND regexp_matches(c.architecture, '{PLATFORM}')
                   AND (COALESCE(c.variant, '') = '' OR regexp_matches(c.variant, '{PLATFORM}')), false) THEN 'platform_invalid'
              WHEN (d.os IS NOT NULL OR d.architecture IS NOT NULL OR d.variant IS NOT NULL)
                   AND (d.os IS DISTINCT FROM c.os OR d.architecture IS DISTINCT FROM c.architecture
                        OR COALESCE(d.variant, '') <> COALESCE(c.variant, '')) THEN 'platform_mismatch' END AS violation
  FROM image_descriptors d JOIN reachable r ON r.archive_id = d.archive_id AND r.digest = d.parent
  LEFT JOIN image_manifests m ON m.digest = d.digest LEFT JOIN image_configs c ON c.digest = m.config
  LEFT JOIN held h ON h.manifest = d.digest
)"""


def _checked(d, walk):
    return images.manifest_check(
        d.image_roots, walk, d.image_descriptors, d.image_manifests, d.image_configs, d.image_layers
    )


@query("image_manifest_check", f"{CHECKED} SELECT * FROM checked")
def _(d):
    return _checked(d, images.image_walk(d.image_roots, d.image_edges))


@query("image_scan_targets", f"""{CHECKED}
SELECT c.archive_id, c.digest, first(os) AS os, first(architecture) AS architecture, first(variant) AS variant,
       first(layer_count) AS layer_count, first(n) AS reference_count
FROM checked c JOIN (SELECT archive_id, digest, count(DISTINCT COALESCE(reference, digest)) AS n FROM walk
                     WHERE kind = 'manifest' GROUP BY 1, 2) k ON k.archive_id = c.archive_id AND k.digest = c.digest
WHERE role = 'image' GROUP BY c.archive_id, c.digest HAVING count(violation) = 0""")
def _(d):
    walk = images.image_walk(d.image_roots, d.image_edges)
    return images.scan_targets(walk, _checked(d, walk))


@query("image_members", f"""{WALK}, reached AS (SELECT DISTINCT archive_id, digest FROM walk WHERE kind = 'manifest')
SELECT r.archive_id, m.digest AS manifest, 'config' AS kind, NULL::BIGINT AS ordinal, m.config AS digest
FROM image_manifests m JOIN reached r ON r.digest = m.digest
UNION ALL
SELECT r.archive_id, l.manifest, 'layer', l.ordinal, l.digest FROM image_layers l JOIN reached r ON r.digest = l.manifest""")
def _(d):
    return images.image_members(images.image_walk(d.image_roots, d.image_edges), d.image_manifests, d.image_layers)


@query("index_references_resolve", """
SELECT m.manifest, count(*) AS member_count, count(*) FILTER (l.digest IS NULL) AS missing_count,
       count(*) FILTER (l.digest IS NULL) = 0 AS valid
FROM image_members m LEFT JOIN image_listing l ON l.manifest = m.manifest AND l.digest = m.digest
GROUP BY m.manifest""")
def _(d):
    return graph.image_completeness(d.image_members, d.image_listing)


@query("unresolved_members", """
SELECT m.manifest, m.digest FROM image_members m WHERE NOT EXISTS (SELECT 1 FROM image_listing l
  WHERE l.manifest = m.manifest AND l.digest = m.digest)""")
def _(d):
    return graph.unresolved_members(d.image_members, d.image_listing).select("manifest", "digest")


# --- classification ---------------------------------------------------------------
MAGICS = """(VALUES (0, 'pe32', 0, '4D5A'), (1, 'elf32', 0, '7F454C4601'),
  (1, 'elf64', 0, '7F454C4602'), (2, 'java-class', 0, 'CAFEBABE'), (3, 'macho-fat', 0, 'CAFEBABE'),
  (4, 'dex', 0, '6465780A'), (5, 'pyc', 2, '0D0A'), (6, 'zip', 0, '504B0304'),
  (8, 'ar', 0, '213C617263683E0A'), (11, 'cab', 0, '4D534346'), (12, 'gzip', 0, '1F8B08'),
  (13, 'bzip2', 4, '314159265359'), (14, 'xz', 0, 'FD377A585A00'), (15, 'zstd', 0, '28B52FFD'),
  (10, 'cpio', 0, '303730373031'), (18, 'squashfs', 0, '68737173'), (7, 'tar', 257, '757374617220'),
  (21, 'mbr-img', 510, '55AA')) AS m(priority, format, start_at, magic)"""
HITS = f"""SELECT DISTINCT blob_id, size_bytes, priority, format FROM blob_contents, {MAGICS}
WHERE substr(hex(content), start_at * 2 + 1, length(magic)) = magic"""


@query("signature_match", f"SELECT blob_id, priority, format FROM ({HITS})")
def _(d):
    return classify.signature_match(d.blob_contents)


CLASSIFIED = f"""SELECT b.blob_id, b.size_bytes, COALESCE(arg_min(h.format, h.priority), 'unknown')
    AS format, COALESCE(string_agg(h.format, ',' ORDER BY h.priority), '') AS candidates,
    count(h.format) > 1 AS ambiguous
  FROM blob_contents b LEFT JOIN ({HITS}) h ON h.blob_id = b.blob_id GROUP BY ALL"""
CATEGORY = """CASE WHEN format IN ('pe32', 'pe32+', 'elf32', 'elf64', 'macho-thin', 'macho-fat',
  'java-class', 'jar', 'war', 'ear', 'dex', 'apk', 'pyc') THEN 'binary'
  WHEN format IN ('zip', '7z', 'rar', 'tar', 'gzip', 'bzip2', 'xz', 'zstd', 'cab', 'cpio', 'ar',
  'deb', 'rpm', 'iso9660') THEN 'archive'
  WHEN format IN ('docker-tar', 'oci-tar', 'ext2', 'ext3', 'ext4', 'mbr-img', 'gpt-img')
  THEN 'container' END"""


@query("classify_blobs", f"""
SELECT blob_id, format, {CATEGORY} AS category FROM ({CLASSIFIED})""")
def _(d):
    return classify.classify_blobs(d.blob_contents).select("blob_id", "format", "category")


@query("signature_priority", f"SELECT blob_id, format, candidates, ambiguous FROM ({CLASSIFIED})")
def _(d):
    return classify.classify_blobs(d.blob_contents).select(
        "blob_id", "format", F.array_join("candidates", ",").alias("candidates"), "ambiguous"
    )


@query("format_census", f"""
SELECT format, {CATEGORY} AS category, count(*) AS blob_count,
       sum(size_bytes)::BIGINT AS total_bytes, count(*) FILTER (ambiguous) AS ambiguous_count
FROM ({CLASSIFIED}) GROUP BY format""")
def _(d):
    return classify.format_census(classify.classify_blobs(d.blob_contents))


@query("category_of_format", f"""
SELECT format, {CATEGORY} AS category, CASE WHEN format = 'ext4' THEN NULL ELSE
  CASE {CATEGORY} WHEN 'archive' THEN NULL ELSE {CATEGORY} END END AS member_category,
  count(*) AS n FROM preview_nodes GROUP BY format""")
def _(d):
    counts = d.preview_nodes.groupBy("format").agg(F.count("*").alias("n"))
    return counts.withColumn("category", classify.category_of_format()).withColumn(
        "member_category", classify.member_category()
    )


@query("intake_validation", """
SELECT upload_id, input_category, CASE WHEN detected_format IS NULL THEN 'unsupported'
  WHEN CASE detected_format WHEN 'elf64' THEN 'binary' WHEN 'zip' THEN 'archive'
       ELSE 'container' END <> input_category THEN 'mismatch' ELSE 'valid' END AS intake_status
FROM intake_profiles""")
def _(d):
    return classify.intake_validation(d.intake_profiles).select(
        "upload_id", "input_category", "intake_status"
    )


@query("classify_zip_listing", """
SELECT archive_id, CASE WHEN bool_or(name = 'AndroidManifest.xml') THEN 'apk'
  WHEN bool_or(name = 'WEB-INF/web.xml') THEN 'war'
  WHEN bool_or(name = 'META-INF/application.xml') THEN 'ear'
  WHEN bool_or(name = 'META-INF/MANIFEST.MF') THEN 'jar' ELSE 'zip' END AS format
FROM archive_entries GROUP BY archive_id""")
def _(d):
    return classify.classify_zip_listing(d.archive_entries)


@query("classify_tar_listing", """
WITH missing AS (SELECT DISTINCT archive_id, kind FROM archive_references r
  WHERE NOT EXISTS (SELECT 1 FROM archive_entries e WHERE e.archive_id = r.archive_id
                    AND e.name = r.name))
SELECT archive_id, CASE
  WHEN bool_or(name = 'oci-layout') AND bool_or(name = 'index.json')
       AND (archive_id, 'oci') NOT IN (SELECT (archive_id, kind) FROM missing) THEN 'oci-tar'
  WHEN bool_or(name = 'manifest.json')
       AND (archive_id, 'docker') NOT IN (SELECT (archive_id, kind) FROM missing)
  THEN 'docker-tar' ELSE 'tar' END AS format
FROM archive_entries GROUP BY archive_id""")
def _(d):
    return classify.classify_tar_listing(d.archive_entries, d.archive_references)


@query("page_archive_listing", r"""
SELECT archive_id, count(*) AS entry_count, CASE WHEN bool_or(name = 'META-INF/MANIFEST.MF')
  THEN 'jar' ELSE 'zip' END AS format
FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS archive_id,
             regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS name FROM pages)
GROUP BY archive_id""")
def _(d):
    entries = d.pages.select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("archive_id"),
        F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1).alias("name"),
    )
    counts = entries.groupBy("archive_id").agg(F.count("*").alias("entry_count"))
    return classify.classify_zip_listing(entries).join(counts, "archive_id")


STATUS_REASON = """CASE extraction_status WHEN 'password_required' THEN 'encrypted'
  WHEN 'invalid_path' THEN CASE error_code WHEN 'duplicate_logical_path' THEN 'duplicate_path'
       ELSE 'invalid_path' END
  WHEN 'limit_exceeded' THEN CASE error_code WHEN 'max_entry_bytes' THEN 'entry_too_large'
       ELSE 'limit_exceeded' END
  WHEN 'corrupt' THEN 'corrupt_entry' WHEN 'unsupported' THEN 'unsupported_format'
  WHEN 'cancelled' THEN 'cancelled'
  ELSE COALESCE(NULLIF(error_code, ''), 'not_extractable') END"""
REASONED = f"""SELECT *, CASE
  WHEN NOT starts_with(logical_path, '/') OR logical_path LIKE '%//%'
       OR logical_path LIKE '%/../%' THEN 'invalid_path'
  WHEN node_type IN ('directory', 'symlink', 'hardlink') THEN node_type
  WHEN node_type <> 'file' THEN 'special_file'
  WHEN extraction_status <> 'extracted' OR error_code <> '' THEN {STATUS_REASON}
  WHEN is_wrapper THEN 'logical_wrapper' WHEN format = 'zip' THEN 'nested_archive'
  WHEN format IN ('ext4', 'unknown') THEN 'unsupported_format'
  WHEN NOT is_materialized OR sha256 = '' THEN 'source_unavailable' END AS skip_reason
FROM preview_nodes"""


@query("archive_candidates", f"""
SELECT node_key, skip_reason, CASE WHEN skip_reason IS NULL THEN 'eligible' ELSE 'skipped' END
  AS status, CASE WHEN skip_reason IS NULL THEN CASE format WHEN 'docker-tar' THEN 'container'
  ELSE 'binary' END END AS category
FROM ({REASONED}) WHERE NOT (node_type = 'directory' AND error_code = ''
    AND extraction_status IN ('recorded', 'extracted'))
  AND NOT (node_type = 'file' AND is_wrapper AND error_code = ''
    AND extraction_status = 'extracted')""")
def _(d):
    listed = classify.persistable_candidates(d.preview_nodes)
    return classify.archive_candidates(listed).select(
        "node_key", "skip_reason", "status", "category"
    )


@query("candidate_summary", f"""
SELECT archive_id, count(*) AS total, count(*) FILTER (skip_reason IS NULL) AS eligible,
       count(*) FILTER (skip_reason IS NOT NULL) AS skipped
FROM ({REASONED}) GROUP BY archive_id""")
def _(d):
    return classify.archive_candidates(d.preview_nodes).groupBy("archive_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("skip_reason").isNull()).alias("eligible"),
        F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"),
    )


@query("duplicate_content", """
SELECT sha256(text) AS sha256, count(*) AS entry_count, min(concat('doc/', doc_id)) AS first_entry,
       max(strlen(text)) AS size_bytes, max(strlen(text)) * (count(*) - 1) AS saved_bytes
FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def _(d):
    files = d.documents.select(
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size_bytes"),
        F.concat(F.lit("doc/"), "doc_id").alias("entry"),
    )
    return classify.duplicate_content(files)


@query("multi_release_select", r"""
WITH parsed AS (SELECT archive_id, entry_key, name, CASE
    WHEN NOT starts_with(name, 'META-INF/versions/') THEN 0
    WHEN regexp_full_match(split_part(name, '/', 3), '9|[1-9][0-9]{1,2}')
    THEN CAST(split_part(name, '/', 3) AS INT) END AS release,
    CASE WHEN starts_with(name, 'META-INF/versions/')
         THEN array_to_string(string_split(name, '/')[4:], '/') ELSE name END AS logical_path
  FROM archive_entries WHERE name LIKE '%.class')
SELECT archive_id, logical_path, release, name, entry_key FROM parsed
WHERE release = 0 OR (archive_id % 3 <> 0 AND release <= 17)
QUALIFY row_number() OVER (PARTITION BY archive_id, logical_path
                           ORDER BY release DESC, entry_key) = 1""")
def _(d):
    flags = d.orders.select(
        F.col("o_orderkey").alias("archive_id"), (F.col("o_orderkey") % 3 != 0).alias("multi_release")
    )
    return classify.multi_release_select(d.archive_entries, flags, 17)
