"""Shared compare logic: row count, column names and an order-insensitive
hash of normalised values (same rules as scripts/oracle_check.py)."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return norm(v.item())
    return v


def rows_of(cols, records):
    return sorted(repr(tuple(norm(r[c]) for c in cols)) for r in records)


def compare(sdf, con, sql):
    cols = sorted(sdf.columns)
    s = rows_of(cols, [r.asDict() for r in sdf.collect()])
    rel = con.sql(sql)
    dcols = rel.columns
    assert sorted(dcols) == cols, (cols, dcols)
    d = rows_of(cols, [dict(zip(dcols, r)) for r in rel.fetchall()])
    assert len(s) == len(d), (len(s), len(d))
    diff = sorted(set(s) ^ set(d))[:4]
    assert s == d, diff
