"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import database, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 30


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
