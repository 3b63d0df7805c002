"""Registered queries against their SQL at the smallest scale."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert difference(con, SQL[name], entry.queries()[name](spark, SF)) is None


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "subtype", "time", "n_risk", "n_event", "survival", "lower", "upper"]
