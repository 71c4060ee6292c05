"""Run registered queries against their DuckDB oracle (row count, columns and an
order-insensitive value hash), the way the correctness gate does."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"rows differ: spark={len(s_rows)} duck={len(d_rows)}"
    a, b = digest(s_cols, s_rows), digest(d_cols, d_rows)
    if a != b:
        # show one differing row
        order = lambda cols: sorted(range(len(cols)), key=lambda i: cols[i])
        sa = sorted(repr(tuple(_norm(r[i]) for i in order(s_cols))) for r in s_rows)
        sb = sorted(repr(tuple(_norm(r[i]) for i in order(d_cols))) for r in d_rows)
        diff = [(x, y) for x, y in zip(sa, sb) if x != y][:2]
        return False, f"values differ: {diff}"
    return True, f"{len(s_rows)} rows"
