"""Rows of a Spark result and of DuckDB on the same tables, in one form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    got = con.sql(sql)
    names = sorted(got.columns)
    order = [got.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[k]) for k in order) for r in got.fetchall()), key=repr)
