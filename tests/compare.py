"""Comparison of a Spark result with DuckDB's, order-insensitive, doubles to six digits."""

import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr), [names[i] for i in order]


def check(df, con, sql):
    cursor = con.execute(sql)
    want, want_names = rows([c[0] for c in cursor.description], cursor.fetchall())
    have, have_names = rows(df.columns, [tuple(r) for r in df.collect()])
    assert have_names == want_names
    assert len(have) == len(want)
    assert have == want
