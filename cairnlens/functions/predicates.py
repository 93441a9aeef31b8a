"""Row predicates and labels used across the search and report queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlens import vocab


def instant(value: datetime | str | Column) -> Column:
    """A timestamp argument, read as UTC."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp")


def any_of(column: str, values: list[str]) -> Column:
    return F.col(column).isin(values)


def contains_text(column: str, keyword: str) -> Column:
    """Case- and accent-insensitive "contains"; the keyword holds no wildcards.

    ASCII text takes the cheap lower-case comparison; only other text needs the
    collated one.
    """
    text = F.col(column)
    collated = F.contains(
        F.collate(text, "UNICODE_CI_AI"), F.collate(F.lit(keyword), "UNICODE_CI_AI")
    )
    if not keyword.isascii():
        return collated
    plain = F.contains(F.lower(text), F.lit(keyword.lower()))
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(collated)


def input_type(column: str = "root_format") -> Column:
    return F.lower(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")))


def has_tag(column: str, tag: str) -> Column:
    tags = F.from_json(F.col(column), "array<string>")
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def created_between(
    column: str, first: date | str | None, last: date | str | None
) -> Column:
    """Both days inclusive."""
    out = F.lit(True)
    if first is not None:
        out = out & (F.col(column) >= instant(str(first)))
    if last is not None:
        out = out & (F.col(column) < instant(str(last)) + F.expr("INTERVAL 1 DAY"))
    return out


def sample_relation(as_of) -> Column:
    """deleted wins over expired; everything else is retained."""
    return (
        F.when(F.col("sample_deleted_at").isNotNull(), "deleted")
        .when(F.col("sample_expires_at") <= instant(as_of), "expired")
        .otherwise("retained")
    )


def event_severity() -> Column:
    return (
        F.when((F.col("status") == "FAILED") | F.col("error_code").isNotNull(), "error")
        .when(
            any_of("status", ["PARTIAL_SUCCEEDED", "CANCEL_REQUESTED"])
            | any_of("risk_level", ["HIGH", "CRITICAL"]),
            "warning",
        )
        .otherwise("info")
    )


def fixable(column: str = "fixed_version") -> Column:
    """A version remains after removing surrounding spaces."""
    return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))


def severity_rank(column: str = "severity") -> Column:
    pairs = [(name, rank) for rank, name in enumerate(vocab.SEVERITIES, start=1)]
    return vocab.mapping_column(F.col(column), pairs, F.lit(0))


def severity_position(column: str = "severity") -> Column:
    """Display position; a value outside the list gets 0 and so sorts first."""
    pairs = [(name, at) for at, name in enumerate(vocab.SEVERITY_DISPLAY_ORDER, start=1)]
    return vocab.mapping_column(F.col(column), pairs, F.lit(0))


def risk_of_rank(rank: Column) -> Column:
    pairs = list(enumerate(vocab.SEVERITIES, start=1))
    return vocab.mapping_column(rank, pairs, F.lit("NONE"))


def recent(column: str, as_of, hours: int = vocab.RECENT_HOURS) -> Column:
    return F.col(column) >= instant(as_of) - F.expr(f"INTERVAL {hours} HOURS")



def account_status(as_of) -> Column:
    """An active account whose lock has not run out shows as locked."""
    locked = (F.col("status") == "active") & (F.col("locked_until") > instant(as_of))
    return F.when(locked, "locked").otherwise(F.col("status"))


def heartbeat_fresh(as_of, max_age_seconds: int = vocab.HEARTBEAT_SECONDS) -> Column:
    age = F.expr(f"INTERVAL {max_age_seconds} SECONDS")
    return (F.col("status") == "ready") & F.col("last_checked_at").between(
        instant(as_of) - age, instant(as_of) + age
    )


def needs_attention() -> Column:
    return (F.upper("status") == "FAILED") | F.upper("risk_level").isin("HIGH", "CRITICAL")


def blank_to(column: str | Column, default) -> Column:
    """Empty or missing text becomes the default."""
    value = F.col(column) if isinstance(column, str) else column
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), default)
