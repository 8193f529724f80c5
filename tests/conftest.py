import glob
import math
import os
import sys
from datetime import UTC
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    if hasattr(value, "isoformat") and getattr(value, "tzinfo", None) is not None:
        return value.astimezone(UTC).replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.fixture
def same(spark, duck):
    """Checks a query against its SQL on the smallest test tables."""

    def check(name, query, sql):
        df = query(spark, DATA)
        ours = rows_of(df.columns, df.collect())
        cursor = duck.execute(sql)
        theirs = [c[0] for c in cursor.description]
        assert sorted(theirs) == sorted(df.columns), name
        assert ours == rows_of(theirs, cursor.fetchall()), name

    return check
