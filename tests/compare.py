"""Run registered queries against their SQL statements on the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when both give the same columns and the same bag of rows."""
    result = query(spark, sf_dir)
    expected = con.execute(sql)
    columns = [d[0] for d in expected.description]
    if sorted(columns) != sorted(result.columns):
        return f"{name}: columns {sorted(result.columns)} against {sorted(columns)}"
    got, want = bag(result.columns, result.collect()), bag(columns, expected.fetchall())
    if got != want:
        extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{name}: {sum(got.values())} against {sum(want.values())} rows; {extra} / {lost}"
    return None
