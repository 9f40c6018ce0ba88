"""A Spark session for all tests, and a comparison of a query with its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(SF_DIR)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_DIR}/{f}')")
    return con


def plain(x: object) -> object:
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return float(x) if abs(x) < 1 << 53 else x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    assert sorted(df.columns) == sorted(names)
    ours = rows_of(df.columns, df.collect())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
