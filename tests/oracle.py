"""Compare a Spark result with DuckDB's over the same tables."""

import glob
import math
import os

import duckdb


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{p}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def assert_same(df, sql, folder):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(folder).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, cur.fetchall())
