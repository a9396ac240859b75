"""Queries of the subpackage that SQL can express, at the smallest size."""

import pytest

from oracle import compare, connect
from sievemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) == ""


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
