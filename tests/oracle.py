"""Comparison of queries with their SQL on DuckDB."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def views(folder=SF):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            p = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype == object:
            df[k] = df[k].map(lambda x: None if x is None else str(x))
        elif str(df[k].dtype).startswith("datetime"):
            df[k] = pd.to_datetime(df[k]).dt.tz_localize(None).astype(str)
        else:
            df[k] = df[k].astype(float).round(9)
    return df.astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan", "-0.0": "0.0"}).sort_values(list(df.columns)).reset_index(drop=True)


def check(spark, query, sql, con, folder=SF):
    a, b = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    pd.testing.assert_frame_equal(plain(a), plain(b), check_dtype=False)
