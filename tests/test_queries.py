"""Every query against its SQL on the smallest data."""

import duckdb
import pytest
from check import compare, duck

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    frame = entry.queries()[name](spark, SF_DIR)
    if sql is None:
        assert frame.count() >= 0
    else:
        assert compare(con, frame, sql) == ""


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"rule_idx", "rule_name", "hits", "jobs"}


def test_a_wrong_result_is_noticed(spark):
    con = duckdb.connect()
    assert compare(con, spark.range(3), "SELECT 1 AS id") != ""
