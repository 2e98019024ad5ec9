"""Compare a query with its checking SQL, independent of row order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder: str, build, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = build(spark, folder)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    con = connect(folder)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    right = _rows(names, cur.fetchall())
    con.close()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if left != right:
        in_l, in_r = set(left), set(right)
        only_l = [r for r in left if r not in in_r][:3]
        only_r = [r for r in right if r not in in_l][:3]
        return f"{len(left)} vs {len(right)} rows; spark {only_l}; sql {only_r}"
    if not left:
        return "no rows"
    return None
