import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(pandas_frame):
    """Sorted rows with columns by name; numbers to six places, all kinds of null alike."""

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return ""
        if isinstance(x, float):
            return f"{x + 0.0:.6f}".rstrip("0").rstrip(".") if abs(x) >= 5e-7 else "0"
        return str(x)

    columns = sorted(pandas_frame.columns)
    return columns, sorted(tuple(plain(x) for x in row) for row in pandas_frame[columns].astype(object).itertuples(index=False))


def same(a, b):
    """Equal rows, numbers within a millionth."""
    (ca, ra), (cb, rb) = rows_of(a), rows_of(b)
    assert ca == cb and len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            assert u == v or abs(float(u) - float(v)) < 2e-6, (x, y)
