"""Every registered query beside its SQL on the smallest sample tables."""

from __future__ import annotations

import pytest

import verify
from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL
from loomstat.plans.catalog import catalog

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return verify.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query(spark, con, name):
    got = verify.spark_rows(queries()[name](spark, SMALL))
    if name in SQL:
        assert verify.difference(got, verify.sql_rows(con, SQL[name])) is None
    else:
        assert got[1]


def test_entry(spark):
    assert entry(spark).count() == 2
