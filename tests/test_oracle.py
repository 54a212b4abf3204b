"""Every registered query against its SQL on the smallest supplied tables."""

import pytest

import __spark_entry__ as contract
from reelgrid import registry
from reelgrid.testing import compare, open_duckdb

FOLDER = "/root/testdata/sf0.001"


registry.load()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    problem = compare(contract.queries()[name](spark, FOLDER), open_duckdb(FOLDER), contract.oracle_sql().get(name))
    assert problem is None or problem.startswith("no rows on either side"), problem


def test_entry(spark):
    assert contract.entry(spark).count() > 0
