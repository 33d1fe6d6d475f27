"""Compare a query with its SQL on DuckDB, as bags of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def tables(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def assert_same(df, sql: str, sf_dir: str) -> None:
    cols = sorted(df.columns)
    found = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    got = tables(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    wanted = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert len(found) == len(wanted)
    assert [(a, b) for a, b in zip(found, wanted, strict=True) if a != b][:3] == []
