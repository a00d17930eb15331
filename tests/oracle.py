"""Compares a query's rows with what DuckDB makes of its SQL."""

import math
import os

import duckdb


def connect(folder):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        db.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def same(df, db, sql):
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want, have = bag(names, got.fetchall()), bag(df.columns, [tuple(r) for r in df.collect()])
    assert have == want
