"""Runs a query and its oracle and compares rows by column name."""

import datetime
import decimal
import glob
import os

import duckdb


def connect(d):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert got == want
