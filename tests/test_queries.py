"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest
from oracle import database, difference

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["sample", "taxon", "reads", "freq"]
