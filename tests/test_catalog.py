import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import assert_same

import __spark_entry__
from clinspark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tiny, name):
    assert_same(QUERIES[name](spark, tiny), SQL[name], tiny)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert sorted(map(str, QUERIES[name](spark, tiny).collect())) == sorted(map(str, rows))  # the same rows each time


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
