"""Every registered query against its checking SQL on the smallest data."""

import pytest

import __spark_entry__ as entry_points
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
CHECKS = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def no_cross_join_and_no_row_at_a_time_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, QUERIES[name], CHECKS.get(name), no_cross_join_and_no_row_at_a_time_python)
    assert ok, note


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 200
