"""Image indexes: what their descriptors lead to, manifests with config and layers."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.session import shared_folder

# --- fixed values: annotations, media types and forms of a descriptor -------------
ATTESTATION = "attestation-manifest"
ATTESTATION_LAYER = "application/vnd.in-toto+json"
DIGEST_FORM = "^sha256:[a-f0-9]{64}$"
PLATFORM_FORM = "^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"
UNKNOWN = "unknown"

NODE = ["archive_id", "digest"]


def _kept(df: DataFrame, location: str) -> DataFrame:
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, [left[n].eqNullSafe(right[n]) for n in names])


def image_walk(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """archive_id, digest, kind, reference, depth: what the root indexes lead to.

    A node has one row for each reference it is named by or inherits, with the least
    number of indexes in between. Each level holds only rows no earlier level has, so
    paths are never listed and cycles end by themselves. Levels are written to the
    shared folder; a lost executor costs one level.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession)
    steps = edges.select(
        "archive_id", F.col("parent").alias("digest"), "child", "child_kind", F.col("reference").alias("own")
    )
    frontier = roots.select(*NODE, F.lit(None).cast("string").alias("reference")).distinct()
    found: list[str] = []
    for depth in itertools.count():
        reached = frontier.join(steps, NODE).select(
            "archive_id", F.col("child").alias("digest"), F.col("child_kind").alias("kind"),
            F.coalesce("own", "reference").alias("reference"), F.lit(depth).alias("depth"),
        ).distinct()
        if found:
            before = spark.read.schema(reached.schema).parquet(*found)
            reached = reached.join(before, _same(reached, before, [*NODE, "kind", "reference"]), "left_anti")
        level = _kept(reached, f"{folder}/level-{depth}")
        found.append(f"{folder}/level-{depth}")
        if level.isEmpty():
            return spark.read.schema(reached.schema).parquet(*found)
        frontier = level.filter(F.col("kind") == "index").select(*NODE, "reference")


def index_layers(roots: DataFrame, edges: DataFrame, walk: DataFrame) -> DataFrame:
    """archive_id, digest, layer: the longest way from a root to each index.

    Indexes no other one leads to are taken off, round after round; a round's number
    is the layer. What is left at the end lies on a cycle or behind one and has no row.
    """
    folder = shared_folder(edges.sparkSession)
    left = _kept(
        roots.select(*NODE).unionByName(walk.filter(F.col("kind") == "index").select(*NODE)).distinct(), f"{folder}/indexes"
    )
    inner = edges.filter(F.col("child_kind") == "index").select("archive_id", "parent", "child").distinct()
    live = _kept(inner.join(left.withColumnRenamed("digest", "parent"), ["archive_id", "parent"], "left_semi"), f"{folder}/edges")
    layers = []
    for number in itertools.count():
        entered = live.select("archive_id", F.col("child").alias("digest")).distinct()
        free = _kept(left.join(entered, NODE, "left_anti").withColumn("layer", F.lit(number)), f"{folder}/layer-{number}")
        layers.append(free)
        if free.isEmpty():
            return reduce(DataFrame.unionByName, layers)
        left = _kept(left.join(free, NODE, "left_anti"), f"{folder}/left-{number}")
        live = _kept(live.join(free.withColumnRenamed("digest", "parent"), ["archive_id", "parent"], "left_anti"), f"{folder}/live-{number}")


def image_index_closure(
    roots: DataFrame, edges: DataFrame, max_depth: int = vocab.INDEX_DEPTH_LIMIT
) -> DataFrame:
    """archive_id, digest, kind, depth, deepest, behind_cycle, too_deep: one row a node.

    ``depth`` and ``deepest`` count the indexes between a root and the node on the
    shortest and the longest way; nodes on a cycle or behind one have no longest way
    and are too deep for any limit.
    """
    walk = image_walk(roots, edges)
    layers = index_layers(roots, edges, walk)
    nearest = walk.groupBy(*NODE, "kind").agg(F.min("depth").alias("depth"))
    parents = roots.select(*NODE).unionByName(walk.filter(F.col("kind") == "index").select(*NODE)).distinct()
    parents = parents.join(layers, NODE, "left").withColumnRenamed("digest", "parent")
    farthest = edges.join(parents, ["archive_id", "parent"]).groupBy(
        "archive_id", F.col("child").alias("digest"), F.col("child_kind").alias("kind")
    ).agg(F.max("layer").alias("layer"), (F.count_if(F.col("layer").isNull()) > 0).alias("behind_cycle"))
    deepest = F.when(~F.col("behind_cycle"), F.col("layer"))
    return nearest.join(farthest, [*NODE, "kind"]).select(
        *NODE, "kind", "depth", deepest.alias("deepest"), "behind_cycle",
        (F.col("behind_cycle") | (F.col("layer") > max_depth)).alias("too_deep"),
    )


def image_targets(walk: DataFrame) -> DataFrame:
    """Image manifests with each reference they are known by; the digest if none."""
    return (
        walk.filter(F.col("kind") == "manifest")
        .select(*NODE, F.coalesce("reference", "digest").alias("reference"))
        .distinct()
    )


def _valid_platform(system: str, machine: str, variant: str) -> Column:
    form = F.lit(PLATFORM_FORM)
    empty = F.coalesce(F.col(variant), F.lit("")) == ""
    return F.coalesce(
        F.rlike(system, form) & F.rlike(machine, form) & (empty | F.rlike(variant, form)), F.lit(False)
    )


def manifest_check(
    roots: DataFrame, walk: DataFrame, descriptors: DataFrame, manifests: DataFrame,
    configs: DataFrame, layers: DataFrame,
) -> DataFrame:
    """archive_id, parent, digest, role, os, architecture, variant, layer_count, violation.

    One row for each manifest descriptor of a reachable index. An attestation must
    name its image, have the unknown platform in descriptor and config, and layers of
    the attestation type only; any other manifest is an image, whose config states a
    valid platform that the descriptor's one, if it has any, repeats.
    """
    reachable = roots.select(*NODE).unionByName(walk.filter(F.col("kind") == "index").select(*NODE)).distinct()
    held = layers.groupBy("manifest").agg(
        F.count("*").alias("layer_count"), F.count_if(~F.col("media_type").eqNullSafe(F.lit(ATTESTATION_LAYER))).alias("other_layers")
    )
    stated = configs.select(
        F.col("digest").alias("config"), F.col("os").alias("config_os"),
        F.col("architecture").alias("config_architecture"), F.col("variant").alias("config_variant"),
    )
    rows = (
        descriptors.join(reachable.withColumnRenamed("digest", "parent"), ["archive_id", "parent"], "left_semi")
        .join(manifests.select(F.col("digest").alias("manifest"), "config"), F.col("digest") == F.col("manifest"), "left")
        .join(stated, "config", "left")
        .join(held, "manifest", "left")
    )

    def unknown(prefix: str) -> Column:
        parts = [F.col(f"{prefix}os").eqNullSafe(F.lit(UNKNOWN)), F.col(f"{prefix}architecture").eqNullSafe(F.lit(UNKNOWN))]
        return reduce(Column.__and__, parts, F.coalesce(F.col(f"{prefix}variant"), F.lit("")) == "")

    attests = F.col("reference_type").eqNullSafe(F.lit(ATTESTATION))
    sound = (
        F.coalesce(F.rlike("reference_digest", F.lit(DIGEST_FORM)), F.lit(False)) & unknown("") & unknown("config_")
        & (F.coalesce("layer_count", F.lit(0)) > 0) & (F.col("other_layers") == 0)
    )
    names = ["os", "architecture", "variant"]
    given = F.coalesce(*names).isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    alike = reduce(Column.__and__, [blank(n) == blank(f"config_{n}") for n in names])
    violation = (
        F.when(attests, F.when(~F.coalesce(sound, F.lit(False)), "attestation_invalid"))
        .when(~_valid_platform("config_os", "config_architecture", "config_variant"), "platform_invalid")
        .when(given & ~(_valid_platform(*names) & alike), "platform_mismatch")
    )
    return rows.select(
        "archive_id", "parent", "digest", F.when(attests, "attestation").otherwise("image").alias("role"),
        *[F.col(f"config_{n}").alias(n) for n in names],
        F.coalesce("layer_count", F.lit(0)).cast("bigint").alias("layer_count"), violation.alias("violation"),
    )


def image_members(walk: DataFrame, manifests: DataFrame, layers: DataFrame) -> DataFrame:
    """archive_id, manifest, kind, ordinal, digest: config and layers of each reachable
    manifest; the config has no ordinal."""
    reached = walk.filter(F.col("kind") == "manifest").select("archive_id", F.col("digest").alias("manifest")).distinct()
    config = manifests.select(
        F.col("digest").alias("manifest"), F.lit("config").alias("kind"), F.lit(None).cast("bigint").alias("ordinal"),
        F.col("config").alias("digest"),
    )
    layer = layers.select("manifest", F.lit("layer").alias("kind"), F.col("ordinal").cast("bigint"), "digest")
    return reached.join(config.unionByName(layer), "manifest").select("archive_id", "manifest", "kind", "ordinal", "digest")


def scan_targets(walk: DataFrame, checked: DataFrame) -> DataFrame:
    """archive_id, digest, os, architecture, variant, layer_count, reference_count: the
    images an archive is scanned for, each once, if none of its descriptors is refused.

    References are counted, not listed: an index may be known by any number.
    """
    names = [F.first(c).alias(c) for c in ("os", "architecture", "variant", "layer_count")]
    images = checked.filter(F.col("role") == "image").groupBy(*NODE).agg(*names, F.count("violation").alias("bad")).filter("bad = 0").drop("bad")
    known = image_targets(walk).groupBy(*NODE).agg(F.count("*").alias("reference_count"))
    return images.join(known, NODE)
