"""Every registered query against its DuckDB statement."""

import pytest
from check import compare, connect
from conftest import SMALL

import __spark_entry__ as entry
from tengen.plans.queries import REGISTRY

QUERIES, ORACLES = REGISTRY, entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert compare(got, con.execute(ORACLES[name]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 6000
