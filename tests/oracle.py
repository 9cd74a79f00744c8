"""Hold a query's rows against its SQL in DuckDB, as multisets with columns by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(path).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list:
    """What only one side has, at most five rows of each, or the unequal column names."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    want, got = rows_of(names, found.fetchall()), rows_of(df.columns, df.collect())
    return [("spark", r) for r in list((got - want).elements())[:5]] + [("sql", r) for r in list((want - got).elements())[:5]]
