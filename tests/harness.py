"""Run a query and its SQL twin side by side and compare the sorted rows exactly."""

import datetime
import decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.5g}" if abs(v) > 1e12 else repr(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return f"{type(v).__name__}:{v}"


def compare(spark_df, con, sql):
    """None when equal, else a short description of the first difference."""
    cols = sorted(spark_df.columns)
    rows = sorted(tuple(norm(v) for v in r) for r in spark_df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in cols] if sorted(names) == cols else None
    if order is None:
        return f"columns {cols} vs {sorted(names)}"
    want = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    if len(rows) != len(want):
        return f"rows {len(rows)} vs {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, cols {cols}: {bad[:2]}"
    return None if rows else "no rows"
