"""Compares a query with its SQL in DuckDB: rows, columns and values, in any order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if hasattr(x, "is_integer") or type(x).__name__ == "Decimal":
        return round(float(x), 9)
    return x


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    got_cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    if got_cols != sorted(names):
        return [f"columns {got_cols} and {sorted(names)}"]
    key = lambda r: tuple(plain(r[c]) for c in got_cols)
    order = lambda t: tuple((x is not None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in t)
    a, b = sorted(map(key, (r.asDict() for r in df.collect())), key=order), sorted(map(key, want), key=order)
    if len(a) != len(b):
        return [f"{len(a)} rows and {len(b)}"]
    return [f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y][:3]
