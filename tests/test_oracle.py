"""Every registered query at the smallest scale: value-exact where SQL exists."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from catalog.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    rows, problems = compare(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name])
    assert not problems
    assert rows > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "jalali_month"
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
