"""Every registered query against its SQL on the smallest data."""

import os
import re

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(FOLDER)


def test_only_training_data_queries_lack_sql():
    """Those have brute-force tests beside their package."""
    assert all(re.match(r"op\d+_|pipeline$", name) for name in QUERIES.keys() - ORACLES.keys())
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    mine = QUERIES[name](spark, FOLDER).toArrow()
    result = compare(mine, duck.sql(ORACLES[name]).to_arrow_table())
    assert result.same, (result.only_spark[:3], result.only_duck[:3])
    assert not result.type_differences


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
