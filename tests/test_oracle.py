"""Every registered query equals its SQL on the smallest test tables."""

import os

import pytest

from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name not in oracle_sql():
        assert df.count() >= 0
        return
    state, note = compare(df, con, oracle_sql()[name])
    assert state in ("exact", "close"), note


def test_entry(spark):
    assert entry(spark).count() > 0
