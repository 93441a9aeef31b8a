"""Search filters, joined views and keyset pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions import text
from cairnlens.functions.predicates import (
    account_status, contains_text, created_between, has_tag, input_type, instant,
)


def task_view(
    tasks: DataFrame, users: DataFrame, uploads: DataFrame, blobs: DataFrame
) -> DataFrame:
    """Tasks with their creator, upload and stored blob."""
    creator = users.select(
        F.col("id").alias("created_by"),
        F.col("public_id").alias("creator_public_id"),
        F.col("username").alias("creator_username"),
        F.col("display_name").alias("creator_name"),
    )
    upload = uploads.select(
        F.col("id").alias("upload_id"), F.col("display_name").alias("upload_name")
    )
    blob = blobs.select(
        F.col("id").alias("blob_id"),
        F.col("size_bytes").alias("blob_size_bytes"),
        F.col("sha256").alias("blob_sha256"),
    )
    return tasks.join(creator, "created_by").join(upload, "upload_id").join(blob, "blob_id")


def task_search(
    view: DataFrame,
    keyword: str = "",
    status: str = "",
    kind: str = "",
    creator: str = "",
    tag: str = "",
    created_from: str | None = None,
    created_to: str | None = None,
    after: tuple | None = None,
) -> DataFrame:
    """Conjunction of the given filters over ``task_view`` rows."""
    tests: list[Column] = []
    if keyword:
        tests.append(contains_text("name", keyword) | contains_text("upload_name", keyword))
    if status:
        tests.append(F.col("status") == status)
    if kind:
        tests.append(input_type() == kind)
    if creator:
        tests.append(
            contains_text("creator_name", creator) | contains_text("creator_username", creator)
        )
    if tag:
        tests.append(has_tag("tags", tag))
    if created_from or created_to:
        tests.append(created_between("created_at", created_from, created_to))
    if after:
        tests.append(before_cursor(*after))
    for test in tests:
        view = view.filter(test)
    return view


def before_cursor(created_at, row_id) -> Column:
    """Rows that follow the cursor in newest-first order."""
    at = instant(created_at)
    return (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < row_id))


def after_cursor(created_at, row_id) -> Column:
    """Rows that follow the cursor in oldest-first order."""
    at = instant(created_at)
    return (F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > row_id))


def page_newest_first(df: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """One page plus one row that tells whether another page follows."""
    rows = df.filter(before_cursor(*after)) if after else df
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(size + 1)


def page_oldest_first(df: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    rows = df.filter(after_cursor(*after)) if after else df
    return rows.orderBy("created_at", "id").limit(size + 1)


def page_by_id(df: DataFrame, size: int, after=None) -> DataFrame:
    rows = df.filter(F.col("id") > after) if after is not None else df
    return rows.orderBy("id").limit(size + 1)


def oldest(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.orderBy(column, "id").limit(limit)


def rule_findings_search(
    findings: DataFrame,
    cwe: str = "",
    severity: str = "",
    function: str = "",
    file: str = "",
    callable_text: str = "",
) -> DataFrame:
    """Equality on class and severity, substring on names; paths compare exactly."""
    if cwe:
        findings = findings.filter(F.col("cwe") == cwe)
    if severity:
        findings = findings.filter(F.col("severity") == severity)
    if function:
        findings = findings.filter(contains_text("function_name", function))
    if file:
        findings = findings.filter(F.contains("logical_path", F.lit(file)))
    if callable_text:
        findings = findings.filter(
            contains_text("callable_name", callable_text)
            | contains_text("type_name", callable_text)
        )
    return findings


def audit_with_actor(logs: DataFrame, users: DataFrame) -> DataFrame:
    actor = users.select(
        F.col("id").alias("actor_user_id"),
        F.col("public_id").alias("actor_public_id"),
        F.col("username").alias("actor_username"),
        F.col("display_name").alias("actor_name"),
    )
    return logs.join(actor, "actor_user_id", "left")


def audit_search(
    view: DataFrame,
    action: str = "",
    outcome: str = "",
    actor: str = "",
    created_from: str | None = None,
    created_to: str | None = None,
) -> DataFrame:
    """Audit rows; both instants inclusive, actor by exact id or name part."""
    if action:
        view = view.filter(F.col("action") == action)
    if outcome:
        view = view.filter(F.col("outcome") == outcome)
    if actor:
        view = view.filter(
            (F.col("actor_public_id") == actor)
            | contains_text("actor_username", actor)
            | contains_text("actor_name", actor)
        )
    if created_from:
        view = view.filter(F.col("created_at") >= instant(created_from))
    if created_to:
        view = view.filter(F.col("created_at") <= instant(created_to))
    return view


def user_search(
    users: DataFrame, as_of, keyword: str = "", role: str = "", status: str = ""
) -> DataFrame:
    users = users.withColumn("account_status", account_status(as_of))
    if keyword:
        users = users.filter(
            contains_text("username", keyword) | contains_text("display_name", keyword)
        )
    if role:
        users = users.filter(F.col("role") == role)
    if status:
        users = users.filter(F.col("account_status") == status)
    return users


def jobs_for_node(jobs: DataFrame, node_id: str) -> DataFrame:
    """Active decompile jobs whose payload targets one file node."""
    target = F.get_json_object("payload", "$.target.file_node_id")
    return jobs.filter(
        (F.col("kind") == "decompile")
        & F.col("status").isin(vocab.ACTIVE_JOB_STATUSES)
        & (target == node_id)
    )


def single_source_jobs(jobs: DataFrame, image_path: str) -> DataFrame:
    """Active image jobs with exactly one source, the given one."""
    sources = F.get_json_object("payload", "$.sources")
    return jobs.filter(
        (F.col("kind") == "image")
        & F.col("status").isin(vocab.ACTIVE_JOB_STATUSES)
        & (F.json_array_length(sources) == 1)
        & (F.get_json_object("payload", "$.sources[0].image_logical_path") == image_path)
    )


def project_events(
    events: DataFrame, prefix: str, ids: DataFrame, paths: list[str]
) -> DataFrame:
    """Events whose type starts with the prefix and whose payload names a listed id."""
    named = F.array_distinct(
        F.array_compact(F.array(*[F.get_json_object("payload", path) for path in paths]))
    )
    # one row per (event, named id): the id list per event is as long as ``paths``
    spread = events.filter(F.startswith("event_type", F.lit(prefix))).withColumn(
        "payload_id", F.explode(named)
    )
    known = ids.select(F.col("id").cast("string").alias("payload_id")).distinct()
    return spread.join(known, "payload_id", "left_semi").dropDuplicates(
        ["task_id", "event_sequence"]
    )


def upload_intake_view(uploads: DataFrame, blobs: DataFrame, profiles: DataFrame) -> DataFrame:
    blob = blobs.select(
        F.col("id").alias("blob_id"), "sha256", F.col("state").alias("blob_state")
    )
    profile = profiles.select(
        F.col("upload_id").alias("id"), "input_category", "detected_format", "validation_status",
        "source_kind",
    )
    return uploads.join(blob, "blob_id", "left").join(profile, "id", "left")


def file_node_view(nodes: DataFrame) -> DataFrame:
    """Nodes with parent path, source container and whether they have children."""
    parent = nodes.select(
        "task_id", F.col("id").alias("parent_id"), F.col("logical_path").alias("parent_path")
    )
    source = nodes.select(
        "task_id",
        F.col("id").alias("source_container_id"),
        F.col("logical_path").alias("source_path"),
        F.col("format").alias("source_format"),
    )
    with_children = (
        nodes.filter(F.col("parent_id").isNotNull())
        .select("task_id", F.col("parent_id").alias("id"))
        .distinct()
        .withColumn("has_children", F.lit(True))
    )
    return (
        nodes.join(parent, ["task_id", "parent_id"], "left")
        .join(source, ["task_id", "source_container_id"], "left")
        .join(with_children, ["task_id", "id"], "left")
        .withColumn("has_children", F.coalesce("has_children", F.lit(False)))
    )


def tree_children(view: DataFrame, parent_id: int | None, size: int, after: int = 0) -> DataFrame:
    """One page of a folder's children, or of the roots."""
    here = F.col("parent_id").isNull() if parent_id is None else F.col("parent_id") == parent_id
    return page_by_id(view.filter(here), size, after)


def source_archive_items(results: DataFrame, projects: DataFrame) -> DataFrame:
    """Live results with their live project, kept even when the project is deleted."""
    live = projects.filter(F.col("deleted_at").isNull()).select(
        "task_id", F.col("id").alias("analyzer_run_id"), "canonical_storage_key",
        "canonical_size_bytes",
    )
    return results.filter(F.col("deleted_at").isNull()).join(
        live, ["task_id", "analyzer_run_id"], "left"
    )


def image_structures(nodes: DataFrame) -> DataFrame:
    """Whitelisted scalar facts of disk and file-system images as JSON text.

    Kept rows are files of a known image format whose metadata is a JSON object and
    holds at least one listed scalar.
    """
    formats = list(vocab.IMAGE_METADATA_KEYS)
    parsed = F.try_parse_json("metadata_json")
    images = (
        nodes.filter((F.col("node_type") == "file") & F.col("format").isin(formats))
        .filter(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")))
        .withColumn("_meta", parsed)
    )

    def entry(key: str) -> Column:
        wanted = [name for name, keys in vocab.IMAGE_METADATA_KEYS.items() if key in keys]
        value = F.try_variant_get(F.col("_meta"), f"$.{key}", "variant")
        kind = F.schema_of_variant(value)
        scalar = ~F.startswith(kind, F.lit("OBJECT")) & ~F.startswith(kind, F.lit("ARRAY")) & (
            kind != "VOID"
        )
        text_form = F.concat(F.lit(f'"{key}":'), F.to_json(value))
        return F.when(F.col("format").isin(wanted) & scalar, text_form)

    keys = sorted({key for keys in vocab.IMAGE_METADATA_KEYS.values() for key in keys})
    entries = F.array_compact(F.array(*[entry(key) for key in keys]))
    return (
        images.withColumn("_entries", entries)
        .filter(F.size("_entries") > 0)
        .withColumn("structure", F.concat(F.lit("{"), F.array_join("_entries", ","), F.lit("}")))
        .drop("_meta", "_entries")
    )


CHUNK_BYTES = 1 << 20
CHUNK_LINES = 4096


def _assembled(ranges: DataFrame, chunks: DataFrame, size: int, cut, joined: str) -> DataFrame:
    """project_id, result_id, fragment: the ranges (first, count) put together from the
    chunks they touch.

    A range meets chunk 0 besides, of which it may take nothing, so that one that lies
    behind the source gives an empty fragment. ``cut(start, count)`` is a chunk's part.
    """
    chunk = lambda at: F.floor(at / F.lit(size)).cast("int")
    last = F.col("first") + F.greatest(F.col("count"), F.lit(1)) - 1
    touched = F.array_union(F.array(F.lit(0)), F.sequence(chunk(F.col("first")), chunk(last)))
    met = ranges.withColumn("_range", F.monotonically_increasing_id()).withColumn(
        "chunk", F.explode(touched)
    ).join(chunks, ["project_id", "chunk"])
    start = F.greatest(F.col("first") - F.col("chunk") * size, F.lit(0))
    stop = F.least(F.col("first") + F.col("count") - F.col("chunk") * size, F.lit(size))
    parts = met.select(
        "project_id", "result_id", "_range", "chunk",
        F.when(stop > start, cut(start.cast("int"), (stop - start).cast("int"))).alias("part"),
    )
    return parts.groupBy("project_id", "result_id", "_range").agg(
        F.expr(f"listagg(part, {joined}) WITHIN GROUP (ORDER BY chunk)").alias("fragment")
    ).drop("_range")


def source_fragments(functions: DataFrame, sources: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Bytes of each function cut from its project's canonical source.

    ``sources`` holds (project_id, content BINARY). Sources are cut into chunks, and
    functions meet only those they touch, so no row holds a whole source or all the
    functions of a project.
    """
    number = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("content") / chunk_bytes), F.lit(1)).cast("int") - 1))
    chunks = sources.select("project_id", "content", number.alias("chunk")).select(
        "project_id", "chunk", F.substring(F.col("content"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("piece")
    )
    ranges = functions.select("project_id", "result_id", F.col("offset_bytes").alias("first"), F.col("length_bytes").alias("count"))
    found = _assembled(
        ranges, chunks, chunk_bytes, lambda start, count: F.substring(F.col("piece"), start + 1, count), "X''"
    )
    return found.withColumn("fragment", F.coalesce("fragment", F.lit("").cast("binary")))


def source_line_slices(functions: DataFrame, sources: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Lines of each function cut from its project's text, which is met in chunks of
    lines.

    ``sources`` holds (project_id, text); lines count from 1, both ends inclusive.
    """
    number = F.explode(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / chunk_lines).cast("int")))
    chunks = sources.select("project_id", F.split("text", "\n").alias("_lines")).select("project_id", "_lines", number.alias("chunk")).select(
        "project_id", "chunk", F.slice("_lines", F.col("chunk") * chunk_lines + 1, F.lit(chunk_lines)).alias("piece")
    )
    ranges = functions.select(
        "project_id", "result_id", (F.col("start_line") - 1).alias("first"),
        (F.col("end_line") - F.col("start_line") + 1).alias("count"),
    )
    def cut(start: Column, count: Column) -> Column:
        taken = F.slice(F.col("piece"), start + 1, count)
        return F.when(F.size(taken) > 0, F.array_join(taken, "\n"))

    found = _assembled(ranges, chunks, chunk_lines, cut, "'\\n'")
    return found.withColumn("fragment", F.coalesce("fragment", F.lit("")))


def _scalars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, path, keys, value) of every scalar of each JSON text, through objects and
    arrays of any depth; broken texts give none."""

    def refuse(name):
        raise ValueError(name)

    for batch in batches:
        out = []
        for row_id, document in zip(batch.column("id").to_pylist(), batch.column("document").to_pylist()):
            try:
                root = json.loads(document, parse_constant=refuse) if document is not None else None
            except (ValueError, RecursionError):
                continue
            open_ = [("$", (), root)]
            while open_:
                path, keys, value = open_.pop()
                if isinstance(value, dict):
                    open_ += [(f"{path}.{k}", (*keys, k), v) for k, v in value.items()]
                elif isinstance(value, list):
                    open_ += [(f"{path}[{i}]", keys, v) for i, v in enumerate(value)]
                elif keys:
                    out.append((row_id, path, keys, value if isinstance(value, str) else json.dumps(value)))
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], batch.column("id").type), pa.array(columns[1], pa.string()),
             pa.array([list(k) for k in columns[2]], pa.list_(pa.string())), pa.array(columns[3], pa.string())],
            ["id", "path", "keys", "shown_value"],
        )


def redacted_metadata(logs: DataFrame, column: str = "metadata_json") -> DataFrame:
    """Scalar metadata values by path, without those below a sensitive key.

    Objects and arrays are opened at every level, each log is read once, and a value
    shows whole.
    """

    def allowed(key: Column) -> Column:
        low = F.lower(text.trim_space(key))
        flat = F.regexp_replace(low, r"[-. ]", "_")
        bad = low.isin(vocab.FORBIDDEN_METADATA_KEYS) | (flat == "source_ip")
        for part in vocab.FORBIDDEN_METADATA_PARTS:
            bad = bad | F.contains(flat, F.lit(part))
        return ~bad & text.valid_text(key, 128)

    kind = dict(logs.dtypes)["id"]
    opened = logs.select("id", F.col(column).alias("document")).mapInArrow(
        _scalars, f"id {kind}, path string, keys array<string>, shown_value string"
    )
    return opened.filter(F.forall("keys", allowed)).drop("keys")
