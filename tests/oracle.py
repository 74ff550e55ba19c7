"""Runs a query and its SQL side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(t)[:-8]} as select * from read_parquet('{t if os.path.isfile(t) else t + '/*.parquet'}')")
    return con


def rows_of(df) -> tuple[list[str], list[str]]:
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[str]]:
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())
