"""Holds a query's rows against its SQL's in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TESTDATA = "/root/testdata"


def duck(sf_dir: str, sql: str) -> list[tuple]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return [tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in cursor.fetchall()], sorted(names)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def differences(spark, query, sql: str, sf_dir: str) -> list[str]:
    """What differs; nothing if names and all rows are equal."""
    rows = query(spark, sf_dir)
    want, names = duck(sf_dir, sql)
    if sorted(rows.columns) != names:
        return [f"columns {sorted(rows.columns)} and {names}"]
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    got = sorted((tuple(plain(r[n]) for n in names) for r in rows.collect()), key=key)
    want = sorted((tuple(plain(v) for v in r) for r in want), key=key)
    if len(got) != len(want):
        return [f"{len(got)} rows and {len(want)}"]
    return [f"{a} and {b}" for a, b in zip(got, want, strict=True) if a != b][:3]
