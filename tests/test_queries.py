"""Every registered query against its SQL twin."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.support.compare import difference, duck, duck_rows, spark_rows
from tidewire.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    assert got[1]
    if name in SQL:
        assert difference(got, duck_rows(con, SQL[name])) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(SQL) <= set(QUERIES) <= set(queries())
