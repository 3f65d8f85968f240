"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from siltworks.samples.oracles import ORACLES
from siltworks.samples.registry import QUERIES
from siltworks.samples.views import TABLES
from tools.check import rows as sorted_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 26


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = sorted_rows(entry_points.queries()[name](spark, SF).toArrow())
    assert got == sorted_rows(duck.sql(entry_points.oracle_sql()[name]).to_arrow_table())
