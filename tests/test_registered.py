"""Every registered query beside its SQL on the smallest tables, and a look at the plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        result = con.execute(sql)
        assert sorted(df.columns) == sorted(d[0] for d in result.description)
        assert got == rows_of([d[0] for d in result.description], result.fetchall())


def test_text_filter_reaches_the_scan(spark):
    plan = entry.queries()["search_text_like"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(p_name,red)" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
