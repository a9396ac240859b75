"""Every registered query that has SQL gives the rows of that SQL at the smallest size."""

import os

import pytest

from oracle import compare, connect
from sievemark.jobs import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
