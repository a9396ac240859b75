"""Queries on a question's rows shuffle them once."""

import pytest

from sievemark.jobs import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,most", [("au05_enforced_answers", 1), ("ch09_sections", 1), ("au04_issue_counts", 4)])
def test_shuffled_once(spark, name, most):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most and "Window" in plan
