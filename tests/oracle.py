"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame, columns):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, float) else tuple(x) if isinstance(x, (list, tuple)) else x

    return sorted((tuple(plain(x) for x in r) for r in frame), key=repr) if columns else []


def compare(spark, sf_dir: str, f, sql: str) -> str:
    """An empty string if the rows agree, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = f(spark, sf_dir)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    columns = sorted(names)
    a = rows_of(([r[c] for c in columns] for r in got.collect()), columns)
    b = rows_of(([r[names.index(c)] for c in columns] for r in want.fetchall()), columns)
    if a == b:
        return ""
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    return str(next((x, y) for x, y in zip(a, b, strict=True) if x != y))
