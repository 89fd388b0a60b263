"""Compares a query with its SQL in DuckDB on the same tables."""

import glob
import math
import os


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, int):
        return v
    return round(v, 9) if isinstance(v, float) else str(v)


def same(df, con, sql):
    cols = sorted(df.columns)
    ours = [tuple(plain(v) for v in r) for r in df.select(cols).collect()]
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    theirs = [tuple(plain(v) for v in r) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)
    return len(ours)
