"""Every named query against its SQL twin on the smallest tables."""

import os

import pytest
from compare import differences, open_tables

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    assert differences(spark, tables, SF, entry_module.queries()[name], SQL[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(entry_module.WORKLOADS) <= set(SQL)
