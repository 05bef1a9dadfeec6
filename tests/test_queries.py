"""Every registered query against its SQL, value by value."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from netkpi.plans import registered
from oracle import all_sql
from tests.conftest import SF_DIR

QUERIES = registered.all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return connection


def _rows(pdf):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return x if isinstance(x, str) else repr(float(x))

    columns = sorted(pdf.columns)
    return columns, sorted(tuple(map(value, r)) for r in pdf[columns].itertuples(index=False, name=None))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = _rows(QUERIES[name](spark, SF_DIR).toPandas())
    want = _rows(duck.sql(SQL[name]).df())
    assert got == want
