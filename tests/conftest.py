import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    import decimal
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    listed = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(norm(v) for v in r) for r in con.sql(f"SELECT {listed} FROM ({sql})").fetchall()), key=repr)
    assert got == want


def drained(q, seconds=150):
    """Wait for a stream with timers, which runs micro-batches without rows for ever, to have read all rows; then stop it."""
    import time

    end = time.time() + seconds
    try:
        while len(last := q.recentProgress[-3:]) < 3 or any(p["numInputRows"] for p in last):  # a batch that was cut off runs again
            assert q.exception() is None and q.isActive and time.time() < end
            time.sleep(0.2)
    finally:
        q.stop()
