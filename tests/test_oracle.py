"""Every registered query agrees with its oracle SQL on the smallest data set."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    result = queries()[name](spark, SF)
    sql = oracle_sql().get(name)
    if sql is None:
        assert result.count() > 0
    else:
        assert difference(result, db, sql) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
