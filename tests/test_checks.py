"""Every registered query against DuckDB, and the shape of its plan."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()
CHECK_SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    got = compare.spark_rows(df)
    if name in CHECK_SQL:
        assert compare.difference(got, compare.duck_rows(duck, CHECK_SQL[name])) is None
    assert got[1], "a query that returns nothing proves nothing"


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_check_sql_has_queries():
    assert set(CHECK_SQL) <= set(QUERIES)
