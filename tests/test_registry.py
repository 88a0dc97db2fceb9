"""Every registered query against its SQL, at the smallest scale."""

import pytest
from compare import connect, from_spark, from_sql

from burnish.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
WITH_SQL = [n for n, e in REGISTRY.items() if e.sql]
WITHOUT_SQL = [n for n, e in REGISTRY.items() if not e.sql]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_agrees_with_sql(spark, con, name):
    entry = REGISTRY[name]
    columns, rows = from_spark(entry.query(spark, SF))
    assert (columns, rows) == from_sql(con, entry.sql)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_has_rows(spark, name):
    assert REGISTRY[name].query(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
