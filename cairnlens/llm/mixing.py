"""Mixing sources to target weights by hierarchical budgeting.

Documents form a tree domain > language > source. A node's budget is shared among
its children in proportion to their weights; a child never gets more than its
subtree can give (tokens times ``max_epochs``). What a child cannot take goes to its
siblings first, by raising the common level; only what all of them cannot take stays
with the node above, whose own share was capped by the same rule. A leaf then takes
its documents as whole epochs and a prefix, in tokens, of one more epoch in seeded
order. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlens.functions.chunks import prefix_totals
from cairnlens.llm.common import text_or_empty, written

LEVELS = ("domain", "language", "origin")
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
DOMAINS = 4
DOMAIN_WEIGHTS = {"domain0": 3, "domain1": 2, "domain2": 2, "domain3": 1}
MAX_EPOCHS = 2
SEED = "mix-1"
ORDER_BITS = 40
SPAN = 1 << 30  # 1024 stretches of the order per leaf


def default_domain(source: Column) -> Column:
    """Domain of a source: the CRC-32 of its name modulo four (sample rule)."""
    return F.concat(F.lit("domain"), (F.crc32(source.cast("binary")) % DOMAINS).cast("string"))


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"[\x09-\x0D\x20]+"), "")).cast("bigint")


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    result = F.lit(1)
    for key, value in sorted(weights.items()):
        result = F.when(name == key, value).otherwise(result)
    return result.cast("bigint")


def share(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``children`` (parents, name, weight, room, budget of the parent) plus ``part``.

    In ascending order of room per weight, a child is full if its room is at most
    its weight's share of what the earlier full ones left. All others get that share
    (rounded down) at the first one's level. Children of one parent are few, as they
    are counted nodes, not documents.
    """
    order = [F.col("room") / F.col("weight"), F.col(name)]
    window = Window.partitionBy(*parents).orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    onward = window.rowsBetween(0, Window.unboundedFollowing)
    step = (
        children.withColumn("_left", F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(onward))
        .withColumn("_full", F.col("room") * F.col("_weights") <= F.col("weight") * F.col("_left"))
    )
    whole = Window.partitionBy(*parents)
    level = F.min(F.when(~F.col("_full"), F.struct("_place", "_left", "_weights"))).over(whole)
    return (
        step.withColumn("_place", F.row_number().over(window)).withColumn("_level", level)
        .withColumn("part", F.when(F.col("_full"), F.col("room")).otherwise(
            F.expr("weight * _level._left div _level._weights")))
        .drop("_left", "_weights", "_full", "_place", "_level", "budget")
    )


def leaf_budgets(leaves: DataFrame, budget: int | None, max_epochs: int, domain_weights, language_weights) -> DataFrame:
    """domain, language, origin, tokens, part: tokens that each leaf is to give."""
    rooms = leaves.withColumn("room", F.col("tokens") * max_epochs)
    total = rooms.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("room"), F.lit(0))).first()
    whole = min(total[0] if budget is None else budget, total[1])
    domains = (
        rooms.groupBy("domain").agg(F.sum("room").alias("room"))
        .withColumn("weight", _weight(F.col("domain"), domain_weights)).withColumn("budget", F.lit(whole).cast("bigint"))
    )
    domains = share(domains, [], "domain")
    languages = (
        rooms.groupBy("domain", "language").agg(F.sum("room").alias("room"))
        .withColumn("weight", _weight(F.col("language"), language_weights))
        .join(domains.select("domain", F.col("part").alias("budget")), "domain")
    )
    languages = share(languages, ["domain"], "language")
    origins = (
        rooms.withColumn("weight", F.lit(1).cast("bigint"))
        .join(languages.select("domain", "language", F.col("part").alias("budget")), ["domain", "language"])
    )
    return share(origins, ["domain", "language"], "origin").select(*LEVELS, "tokens", "part")


def _decided(
    docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
    domain=default_domain, domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    language_weights: Mapping[str, int] = LANGUAGE_WEIGHTS,
) -> DataFrame:
    """row (all columns of ``docs``) and mix, see ``decide``."""
    source = F.coalesce(F.col("source"), F.lit(""))
    named = docs.select(F.struct("*").alias("row"), F.struct(
        domain(source).alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("language"),
        source.alias("origin"), n_words(text_or_empty()).alias("n_tokens"),
    ).alias("mix"))
    slim = written(named.select(
        "row.doc_id", *[F.col(f"mix.{name}").alias(name) for name in LEVELS], F.col("mix.n_tokens").alias("n_tokens")
    ), "mix-tokens")
    leaves = written(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    parts = written(leaf_budgets(leaves, budget, max_epochs, domain_weights, language_weights).select(
        *LEVELS, "part",
        F.when(F.col("tokens") > 0, F.expr("part div tokens")).otherwise(1).cast("bigint").alias("epochs"),
        F.when(F.col("tokens") > 0, F.expr("part % tokens")).otherwise(0).alias("rest"),
    ), "mix-parts")
    key = F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    )), 1, ORDER_BITS // 4), 16, 10).cast("bigint")
    placed = prefix_totals(
        slim.join(parts, list(LEVELS)).where("rest > 0").withColumn("place", key), list(LEVELS), "place",
        {"earlier": F.col("n_tokens")}, ties=["doc_id", "n_tokens"], span=SPAN,
    )
    point = F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "n_tokens")
    ends = written(
        placed.groupBy(*LEVELS).agg(
            F.max(F.when(F.col("earlier") + F.col("n_tokens") <= F.col("rest"), point)).alias("end"),
            # Of rows equal in all keys the first may fit and the last may not.
            F.min(F.when(F.col("earlier") + F.col("n_tokens") > F.col("rest"), point)).alias("beyond"),
        ).join(parts, list(LEVELS), "right")
        .select(*[F.col(name).alias(f"_{name}") for name in LEVELS], "part", "epochs", "end", "beyond"),
        "mix-ends",
    )
    # The leaf table was written, so the planner knows its size when it picks the join.
    joined = named.join(ends, [F.col(f"mix.{name}") == F.col(f"_{name}") for name in LEVELS])
    own = F.struct(
        F.conv(F.substring(F.md5(F.concat_ws(
            "|", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
        )), 1, ORDER_BITS // 4), 16, 10).cast("bigint").alias("place"),
        F.coalesce("row.doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("mix.n_tokens").alias("n_tokens"),
    )
    inside = F.coalesce((own <= F.col("end")) & (F.col("beyond").isNull() | (own < F.col("beyond"))), F.lit(False))
    copies = (F.col("epochs") + inside.cast("bigint")).cast("int")
    return joined.select("row", F.struct(
        *[F.col(f"mix.{name}").alias(name) for name in LEVELS], F.col("mix.n_tokens").alias("n_tokens"),
        F.col("part"), copies.alias("copies"),
    ).alias("mix"))


def decide(docs: DataFrame, **options) -> DataFrame:
    """``docs`` plus a struct ``mix`` (domain, language, origin, n_tokens, part, copies).

    Tokens are white-space words. ``budget`` None: as many as the table has. copies is
    how often the mixture takes the document, 0 to ``max_epochs``: once per whole
    epoch of its leaf, once more if it lies in the prefix of the last epoch whose
    tokens do not exceed the rest. Order in the last epoch: MD5 of seed, epoch and
    doc_id, then doc_id (null first), then tokens; equal rows stand or fall together.
    Null lang and source count as empty names, null text as empty. A leaf without
    tokens takes part with all its documents once. ``mix`` is the only added name.
    """
    return _decided(docs, **options).select("row.*", "mix")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it. Options and edge
    cases: see ``decide``; columns may have any names."""
    rows = _decided(docs, **options).where("mix.copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("row.*")
