"""Content classification: signatures, archive listings, import candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions import text
from cairnlens.functions.keyed import first_per_key


def signature_hits(content: str = "content") -> Column:
    """Every matching signature of a blob as (priority, format), in detector order.

    The signature list is fixed, so each row tests it in place; nothing is joined.
    Only the reach of the longest signature is read from the content.
    """
    head = F.col(content)
    tests = []
    for priority, name, parts in vocab.SIGNATURES:
        checks = [
            F.substring(head, offset + 1, len(magic) // 2) == F.unhex(F.lit(magic))
            for offset, magic in parts
        ]
        matched = reduce(lambda a, b: a & b, checks)
        hit = F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("format"))
        tests.append(F.when(matched, hit))
    return F.array_distinct(F.array_compact(F.array(*tests)))


def signature_match(blobs: DataFrame, content: str = "content") -> DataFrame:
    """One row per blob and matching signature."""
    return blobs.select("blob_id", F.inline(signature_hits(content)))


def classify_blobs(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Format, candidates and category of each blob; first detector wins."""
    head = blobs.withColumn(content, F.substring(F.col(content), 1, vocab.SIGNATURE_REACH))
    named = head.withColumn("_hits", signature_hits(content)).drop(content)
    formats = F.array_distinct(F.transform("_hits", lambda h: h["format"]))
    return (
        named.withColumn("_formats", formats)
        .withColumn("format", F.coalesce(F.get("_formats", F.lit(0)), F.lit("unknown")))
        .withColumn("candidates", F.col("_formats"))
        .withColumn("ambiguous", F.size("_formats") > 1)
        .withColumn("category", category_of_format("format"))
        .drop("_hits", "_formats")
    )


def format_census(classified: DataFrame) -> DataFrame:
    return classified.groupBy("format", "category").agg(
        F.count("*").alias("blob_count"),
        F.sum("size_bytes").alias("total_bytes"),
        F.count_if("ambiguous").alias("ambiguous_count"),
    )


def category_of_format(column: str = "format") -> Column:
    return vocab.mapping_column(F.col(column), vocab.FORMAT_CATEGORIES)


def member_category(column: str = "format") -> Column:
    return vocab.mapping_column(F.col(column), vocab.MEMBER_CATEGORIES)


def intake_validation(profiles: DataFrame, format_column: str = "detected_format") -> DataFrame:
    """Declared against detected category."""
    found = category_of_format(format_column)
    return profiles.withColumn("found_category", found).withColumn(
        "intake_status",
        F.when(F.col("found_category").isNull(), "unsupported")
        .when(F.col("found_category") != F.col("input_category"), "mismatch")
        .otherwise("valid"),
    )


def machine_names(headers: DataFrame) -> DataFrame:
    """Architecture of each program header from its two machine bytes."""
    machines = vocab.frame(
        headers.sparkSession, vocab.MACHINES, "family, machine_code, machine_class, architecture"
    )
    code = text.low_high_byte("machine")
    keyed = headers.withColumn("machine_code", code)
    return keyed.join(
        machines,
        (keyed["family"] == machines["family"])
        & (keyed["machine_code"] == machines["machine_code"])
        & machines["machine_class"].isin(F.lit(0), keyed["word_class"]),
        "left",
    ).select(keyed["*"], F.coalesce(machines["architecture"], F.lit("")).alias("architecture"))


def python_versions(headers: DataFrame) -> DataFrame:
    magics = vocab.frame(
        headers.sparkSession, vocab.PYTHON_MAGICS, "python_magic, python_version, header_size"
    )
    return headers.join(magics, "python_magic", "left")


def classify_zip_listing(entries: DataFrame) -> DataFrame:
    """Package kind of each ZIP archive from its entry names."""
    name = F.regexp_replace(F.replace("name", F.lit("\\"), F.lit("/")), r"^\./", "")

    def has(path: str) -> Column:
        return F.bool_or(name == path)

    marks = entries.groupBy("archive_id").agg(
        has("AndroidManifest.xml").alias("_apk"),
        has("WEB-INF/web.xml").alias("_war"),
        has("META-INF/application.xml").alias("_ear"),
        has("META-INF/MANIFEST.MF").alias("_jar"),
    )
    kind = (
        F.when(F.col("_apk"), "apk").when(F.col("_war"), "war").when(F.col("_ear"), "ear")
        .when(F.col("_jar"), "jar").otherwise("zip")
    )
    return marks.select("archive_id", kind.alias("format"))


def unresolved_references(references: DataFrame, entries: DataFrame) -> DataFrame:
    """References to members the archive does not contain."""
    listed = entries.select("archive_id", "name").distinct()
    return references.join(listed, ["archive_id", "name"], "left_anti")


def classify_tar_listing(entries: DataFrame, references: DataFrame) -> DataFrame:
    """Image layout of each TAR archive; every referenced member must be present."""
    missing = (
        unresolved_references(references, entries).select("archive_id", "kind").distinct()
        .groupBy("archive_id")
        .agg(
            F.bool_or(F.col("kind") == "docker").alias("_no_docker"),
            F.bool_or(F.col("kind") == "oci").alias("_no_oci"),
        )
    )
    marks = entries.groupBy("archive_id").agg(
        F.bool_or(F.col("name") == "manifest.json").alias("_manifest"),
        F.bool_or(F.col("name") == "oci-layout").alias("_layout"),
        F.bool_or(F.col("name") == "index.json").alias("_index"),
    )
    whole = lambda column: ~F.coalesce(column, F.lit(False))
    kind = (
        F.when(F.col("_layout") & F.col("_index") & whole("_no_oci"), "oci-tar")
        .when(F.col("_manifest") & whole("_no_docker"), "docker-tar")
        .otherwise("tar")
    )
    return marks.join(missing, "archive_id", "left").select("archive_id", kind.alias("format"))


def archive_candidates(nodes: DataFrame) -> DataFrame:
    """Each archive member as a task candidate or with its first skip reason."""
    status, code = F.col("extraction_status"), F.col("error_code")
    by_status = (
        F.when(status == "password_required", "encrypted")
        .when((status == "invalid_path") & (code == "duplicate_logical_path"), "duplicate_path")
        .when(status == "invalid_path", "invalid_path")
        .when((status == "limit_exceeded") & (code == "max_entry_bytes"), "entry_too_large")
        .when(status == "limit_exceeded", "limit_exceeded")
        .when(status == "corrupt", "corrupt_entry")
        .when(status == "unsupported", "unsupported_format")
        .when(status == "cancelled", "cancelled")
        .when(code != "", code)
        .otherwise("not_extractable")
    )
    member = member_category()
    kind = F.col("node_type")
    reason = (
        F.when(text.relative_path("logical_path").isNull(), "invalid_path")
        .when(kind.isin("directory", "symlink", "hardlink"), kind)
        .when(kind != "file", "special_file")
        .when((status != "extracted") | (code != ""), by_status)
        .when(F.col("is_wrapper"), "logical_wrapper")
        .when(member.isNull() & F.col("format").isin(vocab.ARCHIVE_FORMATS), "nested_archive")
        .when(member.isNull(), "unsupported_format")
        .when(
            ~F.col("is_materialized") | (F.col("sha256") == "") | (F.col("size_bytes") < 0),
            "source_unavailable",
        )
    )
    return nodes.withColumn("skip_reason", reason).select(
        "*",
        F.when(F.col("skip_reason").isNull(), "eligible").otherwise("skipped").alias("status"),
        F.when(F.col("skip_reason").isNull(), member).alias("category"),
    )


def persistable_candidates(nodes: DataFrame) -> DataFrame:
    """Members worth listing: plain folders and opened wrappers are left out."""
    clean = F.col("error_code") == ""
    quiet_folder = (
        (F.col("node_type") == "directory")
        & clean
        & F.col("extraction_status").isin("recorded", "extracted")
    )
    opened_wrapper = (
        (F.col("node_type") == "file")
        & F.col("is_wrapper")
        & clean
        & (F.col("extraction_status") == "extracted")
    )
    return nodes.filter(~quiet_folder & ~opened_wrapper)


def duplicate_content(files: DataFrame) -> DataFrame:
    """Contents stored under several entries and the bytes one blob saves."""
    return (
        files.groupBy("sha256")
        .agg(
            F.count("*").alias("entry_count"),
            F.min("entry").alias("first_entry"),
            F.max("size_bytes").alias("size_bytes"),
        )
        .filter(F.col("entry_count") > 1)
        .withColumn("saved_bytes", F.col("size_bytes") * (F.col("entry_count") - 1))
    )


def multi_release_select(entries: DataFrame, flags: DataFrame, target_release: int) -> DataFrame:
    """The class file a runtime of ``target_release`` would load for each path.

    ``flags`` holds (archive_id, multi_release). Entries below a versions folder count
    only in multi-release archives, with a plain release number from 9 to the target.
    """
    name = F.col("name")
    release_text = F.regexp_extract(name, r"^META-INF/versions/([^/]+)/.+$", 1)
    versioned = F.startswith(name, F.lit("META-INF/versions/"))
    release = F.when(
        F.rlike(release_text, F.lit(r"^(9|[1-9][0-9]{1,2})$")), release_text.cast("int")
    )
    path = F.regexp_replace(name, r"^META-INF/versions/[^/]+/", "")
    classes = entries.filter(F.endswith(name, F.lit(".class"))).select(
        "archive_id",
        "entry_key",
        "name",
        F.when(versioned, release).otherwise(F.lit(0)).alias("release"),
        F.when(versioned, path).otherwise(name).alias("logical_path"),
    )
    usable = (
        classes.join(flags, "archive_id", "left")
        .filter(
            (F.col("release") == 0)
            | (F.coalesce("multi_release", F.lit(False)) & (F.col("release") <= target_release))
        )
        .filter((F.col("release") == 0) | text.safe_member_path("logical_path"))
        .drop("multi_release")
    )
    return first_per_key(
        usable, ["archive_id", "logical_path"], [F.desc("release"), F.col("entry_key")]
    )
