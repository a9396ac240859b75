"""Compares a query with its SQL on the same tables, whatever the order of rows and columns."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return round(float(v), 6) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, func, sql, sf_dir):
    df = func(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {odd}"
    return ""
