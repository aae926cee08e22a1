from __future__ import annotations

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    return made


def views(folder: str = DATA):
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            path = f"{folder}/{name}"
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(frame, columns):
    import pandas as pd

    def cell(v):
        if v is pd.NA or v is pd.NaT or v is None or v != v:
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


def same_as_sql(frame, sql: str, folder: str = DATA):
    """Compare a DataFrame's rows with DuckDB's, whatever the order."""
    got, want = frame.toPandas(), views(folder).sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical(got, columns) == canonical(want, columns)
