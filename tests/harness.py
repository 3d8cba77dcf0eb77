"""Run a registered query on Spark and its SQL on DuckDB, and compare all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return ("DECIMAL", str(v))
    return v


def rows_of(cols, data):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in idx) for r in data), key=lambda r: tuple((x is not None, str(type(x)), x if not isinstance(x, float) else round(x, 4)) if x is not None else (False, "", 0) for x in r))


def compare(df, sql: str, con) -> str | None:
    """None when equal, else a short account of the difference."""
    rel = con.sql(sql)
    dcols, ddata = rel.columns, rel.fetchall()
    scols, sdata = df.columns, [tuple(r) for r in df.collect()]
    if sorted(dcols) != sorted(scols):
        return f"columns {sorted(scols)} != {sorted(dcols)}"
    a, b = rows_of(scols, sdata), rows_of(dcols, ddata)
    if len(a) != len(b):
        return f"rows spark {len(a)} != duckdb {len(b)}\n  spark  {a[:2]}\n  duckdb {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ on {sorted(scols)}\n  spark  {bad[0][0]}\n  duckdb {bad[0][1]}"
    kinds = []
    if a:
        kinds = [type(x).__name__ + "/" + type(y).__name__ for x, y in zip(a[0], b[0]) if type(x) is not type(y)]
    return f"types {kinds}" if kinds else None
