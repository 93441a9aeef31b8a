"""Which tasks, uploads, blobs and files may be removed, and which are orphans.

Every "not exists" test is an anti join on a key set made distinct first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions.keyed import drop_matching, keep_matching
from cairnlens.functions.predicates import instant


def _task_keys(df: DataFrame, condition) -> DataFrame:
    return df.filter(condition).select(F.col("task_id").alias("id"))


def _finished_or_leased(as_of):
    return (F.col("status") == "completed") | (
        (F.col("status") == "cleaning") & (F.col("lease_until") > instant(as_of))
    )


def expired_samples(
    tasks: DataFrame,
    jobs: DataFrame,
    reports: DataFrame,
    results: DataFrame,
    operations: DataFrame,
    as_of,
) -> DataFrame:
    """Finished tasks whose sample ran out and that nothing still works on."""
    due = tasks.filter(
        (F.col("sample_expires_at") <= instant(as_of))
        & F.col("sample_deleted_at").isNull()
        & F.col("deleted_at").isNull()
        & F.col("status").isin(vocab.TERMINAL_TASK_STATUSES)
    )
    busy_job = F.col("status").isin(vocab.LEASED_JOB_STATUSES) | (
        (F.col("status") == "queued") & (F.col("kind") != "decompile")
    )
    blocked = reduce(
        DataFrame.unionByName,
        [
            _task_keys(jobs, busy_job),
            _task_keys(reports, F.col("status").isin("queued", "generating")),
            _task_keys(results, F.col("status").isin("queued", "running")),
            _task_keys(operations, _finished_or_leased(as_of)),
        ],
    )
    # the four blocking key sets share one shuffle instead of four
    return drop_matching(due, blocked, ["id"])


def ready_for_deletion(
    tasks: DataFrame,
    jobs: DataFrame,
    slots: DataFrame,
    reports: DataFrame,
    project_deletions: DataFrame,
    operations: DataFrame,
    as_of,
) -> DataFrame:
    """Tasks being deleted that hold no job, slot, report or open operation."""
    deleting = tasks.filter((F.col("status") == "DELETING") & F.col("deleted_at").isNull())
    slotted = jobs.join(slots.select(F.col("job_id").alias("id")), "id", "left_semi")
    blocked = reduce(
        DataFrame.unionByName,
        [
            _task_keys(jobs, F.col("status").isin(vocab.ACTIVE_JOB_STATUSES)),
            _task_keys(slotted, F.lit(True)),
            _task_keys(reports, F.col("status").isin("queued", "generating")),
            _task_keys(
                project_deletions,
                F.col("status").isin("pending", "cancelling", "deleting", "failed"),
            ),
            _task_keys(operations, _finished_or_leased(as_of)),
        ],
    )
    return drop_matching(deleting, blocked, ["id"])


def _valid_direct(profiles: DataFrame):
    return (
        (F.col("source_kind") == "direct")
        & (F.col("validation_status") == "valid")
        & F.col("detected_format").isNotNull()
        & (F.col("detected_category") == F.col("input_category"))
    )


def _completed_with_blob(uploads: DataFrame, blobs: DataFrame) -> DataFrame:
    """Completed uploads whose blob is available."""
    available = blobs.filter(F.col("state") == "available").select(F.col("id").alias("blob_id"))
    return keep_matching(uploads.filter(F.col("status") == "completed"), available, ["blob_id"])


def unclaimed_uploads(
    uploads: DataFrame, profiles: DataFrame, blobs: DataFrame, tasks: DataFrame
) -> DataFrame:
    """Valid direct uploads that no task, in any state, ever used."""
    wanted = profiles.filter(
        _valid_direct(profiles) & F.col("input_category").isin("binary", "container")
    ).select(F.col("upload_id").alias("id"), "input_category", "detected_format")
    joined = _completed_with_blob(uploads, blobs).join(wanted, "id")
    return drop_matching(joined, tasks.select(F.col("upload_id").alias("id")), ["id"])


def archives_without_import(
    uploads: DataFrame, profiles: DataFrame, blobs: DataFrame
) -> DataFrame:
    wanted = profiles.filter(
        _valid_direct(profiles)
        & (F.col("input_category") == "archive")
        & F.col("archive_import_id").isNull()
    ).select(F.col("upload_id").alias("id"), "detected_format")
    ready = _completed_with_blob(uploads, blobs).filter(F.col("actual_sha256").isNotNull())
    return ready.join(wanted, "id")


def _archives_in_use(
    uploads: DataFrame, profiles: DataFrame, blobs: DataFrame, imports: DataFrame
) -> DataFrame:
    """Valid archive uploads not imported yet or with an import under way."""
    wanted = profiles.filter(
        _valid_direct(profiles) & (F.col("input_category") == "archive")
    ).select(F.col("upload_id").alias("id"), "archive_import_id")
    running = imports.filter(F.col("status").isin("queued", "running")).select(
        F.col("id").alias("archive_import_id"),
        F.col("upload_id").alias("id"),
        F.lit(True).alias("_running"),
    )
    return (
        _completed_with_blob(uploads, blobs)
        .join(wanted, "id")
        .join(running, ["archive_import_id", "id"], "left")
        .filter(F.col("archive_import_id").isNull() | F.col("_running"))
        .select("id")
    )


def _linked_pending(
    uploads: DataFrame, profiles: DataFrame, entries: DataFrame
) -> DataFrame:
    """Derived uploads linked from an archive entry that still needs them."""
    derived = profiles.filter(F.col("source_kind") == "archive_entry").select(
        F.col("upload_id").alias("id")
    )
    pending = entries.filter(F.col("status").isin("eligible", "failed")).select(
        F.col("derived_upload_id").alias("id")
    )
    done = uploads.filter(F.col("status") == "completed").select("id")
    return keep_matching(done.join(derived, "id", "left_semi"), pending, ["id"])


def _matching_entries(entries: DataFrame, derived: DataFrame) -> DataFrame:
    """Entries that agree with a derived upload in all they say of themselves, so that few
    of them go on to the tables that name their archive."""
    own = {
        "logical_path": "source_entry_path", "detected_category": "input_category",
        "detected_format": "detected_format", "size_bytes": "declared_size_bytes",
        "sha256": "actual_sha256", "blob_id": "blob_id",
    }
    return keep_matching(entries, derived.select(*[F.col(b).alias(a) for a, b in own.items()]), [*own])


def _provenance_pending(
    uploads: DataFrame, profiles: DataFrame, imports: DataFrame, entries: DataFrame
) -> DataFrame:
    """Derived uploads that match a pending, still unlinked entry in every detail."""
    parents = imports.select(
        F.col("id").alias("archive_import_id"), F.col("upload_id").alias("source_parent_upload_id")
    ).join(
        uploads.select(
            F.col("id").alias("source_parent_upload_id"),
            F.col("display_name").alias("source_archive_name"),
        ),
        "source_parent_upload_id",
    )
    derived = (
        profiles.filter(
            (F.col("source_kind") == "archive_entry") & (F.col("validation_status") == "valid")
        )
        .withColumnRenamed("upload_id", "id")
        .join(uploads.filter(F.col("status") == "completed"), "id")
    )
    pending = (
        _matching_entries(entries.filter(
            F.col("status").isin("eligible", "failed") & F.col("derived_upload_id").isNull()
        ), derived)
        .join(parents, "archive_import_id")
        .select(
            "source_parent_upload_id",
            "source_archive_name",
            F.col("logical_path").alias("source_entry_path"),
            F.col("size_bytes").alias("declared_size_bytes"),
            F.col("sha256").alias("actual_sha256"),
            F.col("detected_category").alias("input_category"),
            "detected_format",
            "blob_id",
        )
    )
    return keep_matching(derived, pending, pending.columns).select("id")


def expired_uploads(
    uploads: DataFrame,
    parts: DataFrame,
    profiles: DataFrame,
    blobs: DataFrame,
    tasks: DataFrame,
    imports: DataFrame,
    entries: DataFrame,
    as_of,
) -> DataFrame:
    """Expired uploads that still hold storage and that no one can still use."""
    due = uploads.filter(F.col("expires_at") <= instant(as_of))
    # only expired uploads without a blob need the part test
    bare = (F.col("status") == "expired") & F.col("blob_id").isNull()
    with_parts = keep_matching(
        due.filter(bare), parts.select(F.col("upload_id").alias("id")), ["id"]
    )
    holding = due.filter(~bare).unionByName(with_parts)
    in_use = reduce(
        DataFrame.unionByName,
        [
            unclaimed_uploads(uploads, profiles, blobs, tasks).select("id"),
            _archives_in_use(uploads, profiles, blobs, imports),
            _linked_pending(uploads, profiles, entries).select("id"),
            _provenance_pending(uploads, profiles, imports, entries),
        ],
    )
    return drop_matching(holding, in_use, ["id"])


def orphan_derived_uploads(
    imports: DataFrame, profiles: DataFrame, uploads: DataFrame, entries: DataFrame,
    tasks: DataFrame,
) -> DataFrame:
    """Uploads derived from an archive that became no task and whose entry made none."""
    derived = profiles.filter(F.col("source_kind") == "archive_entry").select(
        F.col("upload_id").alias("id"), "source_parent_upload_id", "source_entry_path"
    )
    live = uploads.filter(
        ~(
            (F.col("status") == "cancelled")
            | ((F.col("status") == "expired") & F.col("blob_id").isNull())
        )
    ).select("id", "created_by")
    parents = imports.select(
        F.col("id").alias("archive_import_id"), F.col("upload_id").alias("source_parent_upload_id")
    )
    # a "created" entry is a lasting marker; any other or no entry leaves an orphan,
    # so an upload is kept out only when all its matching entries were created
    marks = entries.groupBy(
        "archive_import_id", F.col("logical_path").alias("source_entry_path")
    ).agg(F.count_if(F.col("status") != "created").alias("_open"))
    rows = (
        derived.join(live, "id")
        .join(parents, "source_parent_upload_id")
        .join(marks, ["archive_import_id", "source_entry_path"], "left")
        .filter(F.col("_open").isNull() | (F.col("_open") > 0))
    )
    free = drop_matching(rows, tasks.select(F.col("upload_id").alias("id")), ["id"])
    return free.select("id", "created_by").distinct()


def entry_provenance_match(
    entries: DataFrame, imports: DataFrame, uploads: DataFrame, profiles: DataFrame,
    tasks: DataFrame,
) -> DataFrame:
    """Stored uploads and tasks behind each archive entry.

    More than one (task, upload) pair for an entry is a conflict, and so is a pair
    that differs from the link the entry already carries.
    """
    derived = (
        profiles.filter(
            (F.col("source_kind") == "archive_entry") & (F.col("validation_status") == "valid")
        )
        .select(
            F.col("upload_id").alias("id"), "source_parent_upload_id", "source_archive_name",
            "source_entry_path", "input_category", "detected_category", "detected_format",
        )
        .join(
            uploads.select("id", "created_by", "declared_size_bytes", "actual_sha256", "blob_id"),
            "id",
        )
    )
    parent = uploads.select(
        F.col("id").alias("source_parent_upload_id"),
        F.col("display_name").alias("source_archive_name"),
        F.col("created_by").alias("owner"),
    )
    likely = _matching_entries(entries, derived)
    facts = (
        likely.join(
            imports.select(
                F.col("id").alias("archive_import_id"),
                F.col("upload_id").alias("source_parent_upload_id"),
            ),
            "archive_import_id",
        )
        .join(parent, "source_parent_upload_id")
        .select(
            F.col("id").alias("entry_id"),
            "source_parent_upload_id",
            "source_archive_name",
            F.col("logical_path").alias("source_entry_path"),
            F.col("detected_category").alias("input_category"),
            F.col("detected_category").alias("detected_category"),
            "detected_format",
            F.col("owner").alias("created_by"),
            F.col("size_bytes").alias("declared_size_bytes"),
            F.col("sha256").alias("actual_sha256"),
            "blob_id",
            F.col("derived_upload_id").alias("linked_upload_id"),
            F.col("task_id").alias("linked_task_id"),
        )
    )
    found = derived.join(
        tasks.select(F.col("upload_id").alias("id"), F.col("id").alias("found_task_id")), "id", "left",
    ).withColumnRenamed("id", "found_upload_id")
    keys = [
        "source_parent_upload_id", "source_archive_name", "source_entry_path", "input_category",
        "detected_category", "detected_format", "created_by", "declared_size_bytes",
        "actual_sha256", "blob_id",
    ]
    has_task = F.col("found_task_id").isNotNull()
    per_entry = (
        facts.join(found, keys)
        .groupBy("entry_id", "linked_upload_id", "linked_task_id")
        .agg(
            F.count("*").alias("candidate_count"),
            F.count_distinct(
                F.when(has_task, F.struct("found_task_id", "found_upload_id"))
            ).alias("task_count"),
            F.min(F.when(has_task, F.col("found_upload_id"))).alias("upload_id"),
            F.min("found_task_id").alias("task_id"),
        )
    )
    other_link = F.coalesce(F.col("linked_upload_id") != F.col("upload_id"), F.lit(False)) | (
        F.coalesce(F.col("linked_task_id") != F.col("task_id"), F.lit(False))
    )
    return per_entry.withColumn("conflict", (F.col("task_count") > 1) | other_link).select(
        "entry_id", "candidate_count", "task_count", "upload_id", "task_id", "conflict"
    )


def blob_references(
    uploads: DataFrame, tasks: DataFrame, refs: DataFrame, imports: DataFrame, entries: DataFrame
) -> DataFrame:
    """One row per counted reference to a blob."""
    held = tasks.filter(F.col("sample_deleted_at").isNull() & F.col("deleted_at").isNull())
    kept_imports = imports.filter(F.col("source_blob_released_at").isNull()).select(
        F.col("source_blob_id").alias("blob_id")
    )
    kept_entries = entries.filter(F.col("blob_released_at").isNull())
    parts = [uploads, held, refs, kept_imports, kept_entries]
    rows = reduce(DataFrame.unionByName, [part.select("blob_id") for part in parts])
    return rows.filter(F.col("blob_id").isNotNull())


def blob_reference_counts(blobs: DataFrame, references: DataFrame, stale_before) -> DataFrame:
    """Recomputed count and state of every blob, and whether the stored ones drifted."""
    counted = references.groupBy(F.col("blob_id").alias("id")).agg(F.count("*").alias("n"))
    actual = F.coalesce("n", F.lit(0))
    none = F.col("actual_count") == 0
    state = (
        F.when((F.col("actual_count") > 0) & (F.col("state") == "deleting"), "available")
        .when(none & (F.col("state") == "available"), "deleting")
        .when(
            none & (F.col("state") == "staging") & (F.col("created_at") <= instant(stale_before)),
            "deleting",
        )
        .otherwise(F.col("state"))
    )
    return (
        blobs.join(counted, "id", "left")
        .withColumn("actual_count", actual)
        .withColumn("current_state", state)
        .withColumn(
            "drifted",
            (F.col("reference_count") != F.col("actual_count"))
            | (F.col("state") != F.col("current_state")),
        )
        .select("id", "state", "current_state", "reference_count", "actual_count", "drifted")
    )


def blob_orphans(
    inventory: DataFrame, blobs: DataFrame, references: DataFrame, cutoff
) -> DataFrame:
    """Stored blob files no live row protects; young files are left for later."""
    live = blobs.filter(F.col("state") != "deleted").select("storage_key")
    referenced = keep_matching(
        blobs.filter(F.col("state") == "deleted"), references.select(F.col("blob_id").alias("id")),
        ["id"],
    ).select("storage_key")
    old = inventory.filter(F.col("modified_at") <= instant(cutoff))
    return drop_matching(old, live.unionByName(referenced), ["storage_key"])


def stored_file_orphans(
    inventory: DataFrame, reports: DataFrame, artifacts: DataFrame, results: DataFrame
) -> DataFrame:
    """Report, staging, artifact and decompile files without a live row."""
    live_reports = reports.filter(F.col("deleted_at").isNull())
    staged = live_reports.filter(
        (F.col("snapshot_state") == "staged") & F.col("status").isin("queued", "generating")
    ).select(F.concat(F.lit("staging/"), "task_id", F.lit("/"), "id").alias("storage_key"))
    live_artifacts = artifacts.filter(
        F.col("deleted_at").isNull() & F.col("state").isin("staged", "published", "deleting")
    )
    live_results = results.filter(F.col("deleted_at").isNull())
    parts = {
        "report": live_reports,
        "report_staging": staged,
        "artifact": live_artifacts,
        "decompile": live_results,
    }
    known = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(kind).alias("kind"), "storage_key") for kind, df in parts.items()],
    ).filter(F.col("storage_key").isNotNull())
    return drop_matching(inventory, known, ["kind", "storage_key"])


def source_project_orphans(
    folders: DataFrame, projects: DataFrame, deletions: DataFrame
) -> DataFrame:
    """Project folders with neither a live row nor a deletion under way."""
    current = projects.filter(F.col("layout_version") == "project-v1")
    deleting = deletions.select(F.col("active_project_id").alias("id"))
    gone = drop_matching(current.filter(F.col("deleted_at").isNotNull()), deleting, ["id"])
    protected = drop_matching(current, gone, ["id"]).select(
        F.col("id").alias("project_id"), F.col("root_storage_key").alias("storage_key")
    )
    return drop_matching(folders, protected, ["project_id", "storage_key"])


def pending_part_cleanup(uploads: DataFrame, limit: int) -> DataFrame:
    """Finished uploads whose parts still lie in storage, longest untouched first."""
    due = uploads.filter(
        F.col("parts_cleaned_at").isNull()
        & F.col("status").isin("completed", "failed", "expired", "cancelled")
    )
    return due.orderBy("updated_at", "id").limit(limit)
