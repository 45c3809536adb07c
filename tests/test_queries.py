"""Every registered query against its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) == ""


def test_sorted_ticks_come_in_order(spark):
    rows = [tuple(r) for r in entry.queries()["sorted_ticks"](spark, SF_DIR).collect()]
    assert rows == sorted(rows)


def test_entry_has_all_features(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 3 + 22 * 5 + 8
