"""Every registered query against its SQL check, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import compare, connect

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables are not here")
QUERIES, ORACLES = queries(), oracle_sql()
# Nothing passes these thresholds on the smallest tables, so no rows are right.
MAY_BE_EMPTY = {"e3_shadowing_bases", "l2_stream_rate_windows", "l3_stream_fast_flux"}


@pytest.fixture(scope="module")
def tables():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    rows, problem = compare(spark, tables, PATH, QUERIES[name], ORACLES.get(name))
    assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY), problem


def test_checks_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0
