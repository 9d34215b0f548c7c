"""Comparison of a query with its SQL, as multisets of rows with floats rounded."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{source}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def compare(spark, name: str, folder: str, queries: dict, sql: dict) -> tuple[int, int, list, list]:
    df = queries[name](spark, folder)
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    con = views(folder)
    rel = con.sql(sql[name])
    names = list(rel.columns)
    assert sorted(names) == cols, (sorted(names), cols)
    theirs = Counter(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall())
    return sum(ours.values()), sum(theirs.values()), list((ours - theirs).items())[:5], list((theirs - ours).items())[:5]
