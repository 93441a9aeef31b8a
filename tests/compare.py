"""Compare a Spark result with the checking database, ignoring row order."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

from cairnlens import schemas


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in schemas.TABLE_SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else round(float(value), 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in row) for row in df.select(*names).collect())


def check_rows(con, sql):
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    return sorted(names), rows


def differences(df, con, sql) -> str:
    """Empty when equal, else a short description."""
    names, got = spark_rows(df)
    expected_names, expected = check_rows(con, sql)
    if names != expected_names:
        return f"columns {names} vs {expected_names}"
    if got == expected:
        return ""
    more, less = got - expected, expected - got
    return (
        f"rows {sum(got.values())} vs {sum(expected.values())}; "
        f"only here {list(more.items())[:3]}; only there {list(less.items())[:3]}"
    )
