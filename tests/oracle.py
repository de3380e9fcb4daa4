"""Side-by-side check of registered queries against DuckDB on the same parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.9g}"))
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, fn, sql, sf_dir, con):
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    types = {c: t for c, t in df.dtypes}
    if sql is None:
        return True, f"rows-only n={len(got[1])}", took
    rel = con.sql(sql)
    want = rows_of(list(rel.columns), rel.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", took
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}", took
    for a, b in zip(got[1], want[1]):
        if a != b:
            return False, f"first difference\n   spark {a}\n   sql   {b}\n   {types}", took
    return True, f"n={len(got[1])}", took
