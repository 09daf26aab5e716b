"""Every query with an SQL equivalent returns the same rows as that SQL on the smallest tables."""

import pytest
from oracle_check import compare, duck

from placelore.plans import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    problem = compare(registry.queries()[name](spark, FOLDER), con, SQL[name])
    assert problem is None, problem


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
