"""Comparison of a query with its SQL."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if float(v).is_integer() else repr(round(float(v), 10))  # integers with nulls come as floats
    return str(list(v)) if hasattr(v, "tolist") and hasattr(v, "__len__") else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(spark_df, connection, sql: str) -> None:
    got, want = spark_df.toPandas(), connection.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
