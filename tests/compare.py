"""Rows of Spark and DuckDB as comparable text."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{files}')")
    return con


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(text(r[n]) for n in names) for r in df.collect())


def rows_of_duckdb(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    return [rel.columns[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in rel.fetchall())
