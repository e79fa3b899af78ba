"""Comparing a query with its SQL on the test tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb


def connection(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, Decimal):
        return str(v.normalize()) if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())


def oracle_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
