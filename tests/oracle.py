"""Rows of a query by Spark and by DuckDB, in a form that can be compared."""

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(d):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr)


def by_spark(df):
    return rows(df.columns, df.collect())


def by_duckdb(c, sql):
    r = c.execute(sql)
    return rows([x[0] for x in r.description], r.fetchall())
