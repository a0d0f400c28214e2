"""Every registered query next to its SQL, on the smallest tables."""
import os

import pytest

import __spark_entry__ as entry
from compare import compare, connection

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(name, QUERIES[name], SQL.get(name), spark, SF_DIR, con)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
