"""Runs a registered query and its SQL and compares them as multisets of rows."""

from __future__ import annotations

import datetime
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _multiset(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a description of the first differences."""
    names, got = _multiset(df.columns, df.collect())
    cursor = con.execute(sql)
    expected_names, expected = _multiset([c[0] for c in cursor.description], cursor.fetchall())
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if got != expected:
        only_got, only_expected = got - expected, expected - got
        return (
            f"{sum(got.values())} rows against {sum(expected.values())}; "
            f"{sum(only_got.values())} extra such as {only_got.most_common(2)}; "
            f"{sum(only_expected.values())} missing such as {only_expected.most_common(2)}"
        )
    return None
