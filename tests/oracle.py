"""Compares a Spark result with a DuckDB result, order aside."""

import glob
import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def connection(sf_dir: str = SMALL):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple]:
    def one(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "\0null"
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return bool(value)
        if isinstance(value, (int, float)) or type(value).__module__ == "numpy":
            return float(value)
        return str(value)

    rows = [tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((type(v).__name__, v) for v in r))


def assert_same(spark_df, expected: pd.DataFrame) -> None:
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert comparable(got) == comparable(expected)
