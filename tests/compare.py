"""Rows of a Spark query and of its DuckDB statement, in a comparable form."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def views(data: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float, Decimal)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 9)
    if isinstance(value, (list, tuple)):
        return [cell(x) for x in value]
    return str(value)


def rows(columns, records) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([cell(r[i]) for i in order]) for r in records)


def same(df, statement: str, con) -> None:
    found = con.sql(statement)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(found.columns, found.fetchall())
