"""Every registered query that SQL can express, against the oracle engine on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, oracle_connection

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(data):
    return oracle_connection(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, data, oracle, name):
    rows, problem = compare(spark, name, QUERIES[name], ORACLES[name], data, oracle)
    assert problem == "", problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["series_id", "timestamp"]
