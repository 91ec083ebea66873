"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import pytest

import __spark_entry__ as entry
from fairground.plans.registry import QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    status, _, _ = compare(spark, duck, SF, key, entry.queries()[key], entry.oracle_sql().get(key))
    assert status in ("ok", "rows-only")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
