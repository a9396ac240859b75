"""Words of a document are counted where its text is read; nothing is shuffled before the rank."""

import pytest

from sievemark.jobs import registry
from sievemark.operators import lexical, relational

SF = "/root/testdata/sf0.001"
DOCS = [(1, "The cat; the hat"), (2, None), (3, "CAT cat-cat"), (4, "none of it"), (5, "")]


def test_scan_shuffled_once(spark):
    plan = registry.QUERIES["sc08_term_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("most", [200_000, 0])
def test_hits(spark, monkeypatch, most):
    monkeypatch.setattr(relational, "MOST_ROWS", most)
    monkeypatch.setattr(lexical, "_PAIRS", 1)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame([(7, "the cat"), (8, "hat"), (9, None), (10, "dog")], "item_id int, text string")
    assert sorted(map(tuple, lexical.term_scan(docs, queries).collect())) == [(7, 1, 2, 3, 1), (7, 3, 1, 3, 2), (8, 1, 1, 1, 1)]
    assert sorted(map(tuple, lexical.term_scan(docs, queries, all_terms=True).collect())) == [(7, 1, 2, 3, 1), (8, 1, 1, 1, 1)]
