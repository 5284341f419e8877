"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "item"):
        return v.item()
    if v.__class__.__name__ == "Decimal":
        return float(v)
    if v == 0 and isinstance(v, float):
        return 0.0
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    body = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [cols[i] for i in order], sorted(body, key=repr)


def difference(spark_df, con, sql) -> str | None:
    got_cols, got = table(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = dict(spark_df.dtypes)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; {got_cols}; first: {bad[0]}"
    for c, d in zip(want_cols, sorted(cur.description, key=lambda d: d[0]) if cur.description else []):
        if str(d[1]).upper() in ("HUGEINT",) or str(d[1]).startswith("DECIMAL"):
            return f"column {c}: SQL type {d[1]} vs {kinds[c]}"
    return None
