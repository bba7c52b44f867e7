import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    import pandas as pd

    if v is None or v is pd.NA or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        v = float(f"{v:.9g}")
        return int(v) if v.is_integer() else v  # pandas reads whole numbers with nulls among them as floats
    return v


def rows(frame, columns):
    return sorted(tuple(repr(plain(v)) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        a, b = query(spark, SF).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        columns = sorted(a.columns)
        assert rows(a, columns) == rows(b, columns)

    return check
