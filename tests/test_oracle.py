"""Every query against its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import differences, oracle_connection
from tillpulse.oracle import ORACLE
from tillpulse.queries import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(FOLDER)


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(ORACLE)
    assert set(ORACLE) <= set(entry.oracle_sql())
    assert set(all_queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_oracle(spark, duck, name):
    assert differences(all_queries()[name](spark, FOLDER), duck, ORACLE[name]) == []


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
