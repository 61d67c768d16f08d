"""Every registered query against its SQL twin over whole tables."""

import inspect

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
    else:
        assert compare(df, duck, sql) == ""


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(len(inspect.signature(fn).parameters) == 2 for fn in contract.queries().values())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
