"""Every registered query runs; where there is SQL for it, DuckDB gives the same rows."""

import os

import pytest

from tallyloom.plans import ORACLES, QUERIES
from tests.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    _, rows, problem = compare(spark, duck, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert not problem, problem
    if name not in ORACLES:
        assert rows > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    assert row["total_clauses"] == 2 * row["total_contracts"]
    assert set(QUERIES) <= set(entry.queries())
