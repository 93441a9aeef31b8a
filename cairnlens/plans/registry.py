"""The list of runnable queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cairnlens.plans.domain import Domain, check_sql


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Domain], DataFrame]
    check: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(domain) -> DataFrame`` under a name with its checking SQL."""

    def add(fn: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, fn, check_sql(check) if check else None)
        return fn

    return add


def run(name: str, spark, folder: str) -> DataFrame:
    return QUERIES[name].run(Domain(spark, folder))
