"""Vectors of other lengths, with nulls and numbers that aren't finite, and ids that aren't there."""

import pytest

from sievemark.operators import relational, vector


def test_ivf_by_length(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(100, [1.0]), (101, [2.0]), (102, None), (103, [None, 1.0, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [0.0, 0.0, 0.0]), (106, []), (107, [float("inf"), 1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id in (3, 100, 102, 103, 104, 105, 106, 107)").withColumnRenamed("vec_id", "qid").union(spark.createDataFrame([(900, [1.0, 2.0])], "qid long, embedding array<double>"))
    got = vector.ivf_knn(v, asked, 5, recall=1.0).collect()
    assert {r.qid for r in got} == {3, 100} and [r.vec_id for r in got if r.qid == 100] == [101]
    exact = {(r.qid, r.vec_id) for r in vector.knn(v, asked, 5).collect() if r.qid in (3, 100)}
    assert {(r.qid, r.vec_id) for r in got} == exact


def test_unknown_ids(spark):
    df, wanted = spark.range(5).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(1, 4), (2, 7)], "position int, id long")
    assert [(r.position, r.found) for r in relational.in_order(df, "doc_id", wanted).orderBy("position").collect()] == [(1, True), (2, False)]
    with pytest.raises(Exception, match="unknown id: 7"):
        relational.in_order(df, "doc_id", wanted, strict=True).collect()
    assert relational.in_order(df, "doc_id", wanted.where("id < 5"), strict=True).count() == 1
