"""Holds a query's rows against its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(folder):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted("|".join(text(r[k]) for k in order) for r in data)


def check(spark, data, query, sql):
    df = query(spark, data)
    said = views(data).sql(sql)
    assert sorted(df.columns) == sorted(said.columns)
    assert rows(df.columns, df.collect()) == rows(said.columns, said.fetchall())
