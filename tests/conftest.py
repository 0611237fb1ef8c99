import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def duck(sf: str):
    import os

    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{DATA}/{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def normal(df):
    cols = sorted(df.columns)

    def text(x):
        if x is None or x != x:
            return "null"
        if type(x).__name__ in ("bool", "bool_"):
            return str(bool(x))
        try:
            return f"{float(x):.6f}"
        except (TypeError, ValueError):
            return str(x)

    return cols, sorted(tuple(text(x) for x in r) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    """Compares a query with its SQL on one size of the tables."""

    def check(spark, query, sql, sf="sf0.001"):
        assert normal(query(spark, f"{DATA}/{sf}").toPandas()) == normal(duck(sf).execute(sql).df())

    return check
