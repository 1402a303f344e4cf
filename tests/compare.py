"""Order-free comparison of a Spark result with a DuckDB result."""

import numbers

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)):  # a whole number may come as a float
            return repr(round(float(v), 6))
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df, duck_df) -> None:
    a = spark_df.toPandas()
    assert sorted(a.columns) == sorted(duck_df.columns)
    x, y = rows(a), rows(duck_df)
    assert len(x) == len(y)
    assert x == y
