"""Runs registered queries beside their DuckDB equivalents over the smallest tables."""

import datetime as dt
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def connection():
    con = duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}'")
    return con


def compare(spark, con, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = con.sql(sql)
    at = [res.columns.index(c) for c in cols]
    assert sorted(res.columns) == cols
    want = [tuple(plain(r[i]) for i in at) for r in res.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)) if not isinstance(x, int | float) else "n", x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
