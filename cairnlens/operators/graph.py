"""Call graphs, file trees and members of images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions import text
from cairnlens.functions.keyed import first_per_key

# --- fixed values: containers whose members may name them as their source ---------
SOURCE_CONTAINER_FORMATS = [
    "zip", "jar", "war", "ear", "apk", "tar", "docker-tar", "oci-tar", "gzip", "bzip2", "xz",
    "zstd", "lzma", "ar", "deb", "rpm", "cpio", "rar", "7z", "cab", "ext2", "ext3", "ext4",
    "gpt-img", "iso9660", "mbr-img", "squashfs", "udf",
]
LINK_TYPES = ["symlink", "hardlink", "special"]


def call_edges(calls: DataFrame) -> DataFrame:
    """Each (caller, callee) pair once, in order."""
    return calls.select("caller", "callee").distinct().orderBy("caller", "callee")


def outgoing_calls(functions: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Calls out of each function; functions without calls keep one row."""
    entries = entry_points.select("address").distinct().withColumn("is_entry_point", F.lit(True))
    known = functions.select(F.col("address").alias("callee"), F.lit(False).alias("external"))
    calls = (
        edges.select(F.col("caller").alias("address"), "callee")
        .distinct()
        .join(known.distinct(), "callee", "left")
        .withColumn("external", F.coalesce("external", F.lit(True)))
    )
    return (
        functions.join(calls, "address", "left")
        .join(entries, "address", "left")
        .select(
            "address",
            "name",
            F.coalesce("is_entry_point", F.lit(False)).alias("is_entry_point"),
            "callee",
            "external",
        )
    )


def call_totals(functions: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Call counts of each function, summed before the join to the functions."""
    pairs = edges.select(F.col("caller").alias("address"), "callee").distinct()
    counts = pairs.groupBy("address").agg(F.count("*").alias("n"))
    entries = entry_points.select("address").distinct().withColumn("_entry", F.lit(True))
    return (
        functions.join(counts, "address", "left")
        .join(entries, "address", "left")
        .select(
            "address",
            F.coalesce("n", F.lit(0)).alias("outgoing_calls"),
            F.coalesce("_entry", F.lit(False)).alias("is_entry_point"),
        )
    )


def _repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("row_count"))
        .filter("row_count > 1")
        .select(
            F.lit(name).alias("violation"),
            F.concat_ws("/", *[F.col(key).cast("string") for key in keys]).alias("item"),
            "row_count",
        )
    )


def call_graph_check(
    functions: DataFrame, edges: DataFrame, segments: DataFrame, entry_points: DataFrame
) -> DataFrame:
    """Calls from unknown functions and repeated functions, edges, segments, entries."""
    callers = functions.select(F.col("address").alias("caller")).distinct()
    unknown = (
        edges.join(callers, "caller", "left_anti")
        .groupBy("caller")
        .agg(F.count("*").alias("row_count"))
        .select(
            F.lit("unknown_caller").alias("violation"),
            F.col("caller").cast("string").alias("item"),
            "row_count",
        )
    )
    parts = [
        unknown,
        _repeated(functions, ["address"], "duplicate_function"),
        _repeated(edges, ["caller", "callee"], "duplicate_edge"),
        _repeated(segments, ["name", "start_address"], "duplicate_segment"),
        _repeated(entry_points, ["address"], "duplicate_entry_point"),
    ]
    return reduce(DataFrame.unionByName, parts)


def segment_violations(segments: DataFrame) -> DataFrame:
    """Segments with bad permissions, no size or unusable text."""
    bad = F.array_compact(
        F.array(
            F.when(~F.rlike("permissions", F.lit("^[r-][w-][x-]$")), "permissions"),
            F.when(F.col("size_bytes") == 0, "size"),
            F.when(~text.valid_text("name", 512), "name"),
        )
    )
    return segments.select("name", "start_address", F.explode(bad).alias("violation"))


def program_index_counts(index: DataFrame) -> DataFrame:
    """Whether the declared function counts agree with the listed functions."""
    listed = F.size("functions")
    exact = (F.col("decompiled_function_count") == listed) & (
        F.col("candidate_function_count") >= F.col("decompiled_function_count")
    )
    whole = F.col("candidate_function_count") == listed
    return index.withColumn(
        "counts_valid",
        F.when(F.col("completeness") == "complete", exact & whole)
        .when(F.col("completeness") == "partial", exact & (F.col("candidate_function_count") > listed))
        .otherwise(False),
    )


def tree_integrity(nodes: DataFrame, max_depth: int = 10) -> DataFrame:
    """One row per failed check of a file tree; ids are given in listing order."""
    heads = first_per_key(
        nodes.select("task_id", "id", "logical_path", "depth", "node_type", "format"),
        ["task_id", "id"],
        [F.col("logical_path")],
    )
    parent = heads.select(
        "task_id",
        F.col("id").alias("parent_id"),
        F.col("logical_path").alias("_parent_path"),
        F.col("depth").alias("_parent_depth"),
        F.col("node_type").alias("_parent_type"),
    )
    source = heads.select(
        "task_id",
        F.col("id").alias("source_container_id"),
        F.col("node_type").alias("_source_type"),
        F.col("format").alias("_source_format"),
    )
    joined = nodes.join(parent, ["task_id", "parent_id"], "left").join(
        source, ["task_id", "source_container_id"], "left"
    )
    root = F.col("parent_id").isNull()
    folder = text.parent_path("logical_path")
    has_parent = F.col("_parent_path").isNotNull()
    sourced = F.col("source_container_id").isNotNull()
    failed = F.array_compact(
        F.array(
            F.when((F.col("depth") < 1) | (F.col("depth") > max_depth), "depth_range"),
            F.when(root & (F.col("depth") != 1), "root_depth"),
            F.when(root & (folder != "/"), "root_path"),
            F.when(~root & (~has_parent | (F.col("parent_id") >= F.col("id"))), "parent_missing"),
            F.when(has_parent & (F.col("depth") != F.col("_parent_depth") + 1), "depth"),
            F.when(has_parent & (folder != F.col("_parent_path")), "path"),
            F.when(F.col("_parent_type").isin(LINK_TYPES), "parent_type"),
            F.when(F.col("display_name") != text.base_name("logical_path"), "display_name"),
            F.when(
                ~F.col("node_type").isin(vocab.ALLOWED_VALUES[("file_nodes", "node_type")]),
                "node_type",
            ),
            F.when(
                sourced
                & (F.col("_source_type").isNull() | (F.col("source_container_id") >= F.col("id"))),
                "source_missing",
            ),
            F.when(F.col("_source_type") != "file", "source_type"),
            F.when(
                (F.col("_source_type") == "file")
                & ~F.coalesce(F.col("_source_format"), F.lit("")).isin(SOURCE_CONTAINER_FORMATS),
                "source_format",
            ),
        )
    )
    rows = joined.select("task_id", "id", F.explode(failed).alias("violation"))

    repeated_paths = (
        nodes.groupBy("task_id", "logical_path")
        .agg(F.count("*").alias("_n"), F.min("id").alias("id"))
        .filter("_n > 1")
        .select("task_id", "id", F.lit("duplicate_path").alias("violation"))
    )
    return rows.unionByName(_repeated_ids(nodes)).unionByName(repeated_paths)


def _repeated_ids(nodes: DataFrame) -> DataFrame:
    return (
        nodes.groupBy("task_id", "id")
        .agg(F.count("*").alias("_n"))
        .filter("_n > 1")
        .select("task_id", "id", F.lit("duplicate_id").alias("violation"))
    )


def unresolved_members(members: DataFrame, listing: DataFrame) -> DataFrame:
    """Configs, layers and blobs an image names but its archive does not hold."""
    present = listing.select("manifest", "digest").distinct()
    return members.join(present, ["manifest", "digest"], "left_anti")


def image_completeness(members: DataFrame, listing: DataFrame) -> DataFrame:
    """Images with all their members present."""
    present = listing.select("manifest", "digest").distinct().withColumn("_here", F.lit(True))
    return (
        members.join(present, ["manifest", "digest"], "left")
        .groupBy("manifest")
        .agg(
            F.count("*").alias("member_count"),
            F.count_if(F.col("_here").isNull()).alias("missing_count"),
        )
        .withColumn("valid", F.col("missing_count") == 0)
    )
