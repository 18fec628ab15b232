from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(data):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    return connection


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Whether a query gives its oracle's rows, in any order."""
    from collections import Counter

    def check(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        got = Counter(tuple(map(repr, r)) for r in df.select(*names).collect())
        cursor = duck.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == names
        at = [columns.index(n) for n in names]
        want = Counter(tuple(repr(r[i]) for i in at) for r in cursor.fetchall())
        assert got == want

    return check
