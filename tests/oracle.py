"""Comparing a Spark query with its DuckDB text on a folder of Parquet tables."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _text(v) -> str:
    if isinstance(v, (list, np.ndarray)):
        return str([_text(x) for x in v])
    if pd.isna(v):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_text, r)) for r in frame.itertuples(index=False))


def assert_same(spark_frame, duck_frame) -> None:
    a, b = spark_frame.toPandas(), duck_frame.df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)
