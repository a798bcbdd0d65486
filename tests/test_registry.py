"""Registered queries against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from conftest import SF
from flowloom.plans.oracle import oracle_sql
from flowloom.plans.registry import queries

TABLES = ("events", "labels", "lineitem")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    return connection


def _plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return ""
    return value if isinstance(value, str) else repr(float(value))


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(_plain, row)) for row in frame.itertuples(index=False, name=None))


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_duckdb(spark, duck, name):
    mine = queries()[name](spark, SF).toPandas()
    theirs = duck.execute(oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)
