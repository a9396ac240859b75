"""The registered inverted-file query, by its own parameters, against exact search."""

import pytest
from pyspark.sql import functions as F

from sievemark.jobs import registry
from sievemark.operators import vector


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    vec = spark.read.parquet(f"{folder}/embeddings.parquet")
    ask = vec.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r.qid, r.vec_id): r.score for r in vector.knn(vec, ask, 10).collect()}
    near = {(r.qid, r.vec_id): r.score for r in registry.QUERIES["vx03_ivf_topk"](spark, folder).collect()}
    assert len(exact) == 10 * ask.count()
    assert len(exact.keys() & near.keys()) >= 0.95 * len(exact)
    assert all(abs(near[k] - exact[k]) <= 1e-8 for k in exact.keys() & near.keys())


def test_blocks(spark):
    """Cells' vectors and queries meet in blocks, not row by row; with all cells looked into, the search is exact."""
    vec = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(8)]).alias("embedding"))
    ask = vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    near = vector.ivf_knn(vec, ask, 5, probes=3, cells=3)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
    rows = lambda df: sorted((r.qid, r["rank"], r.vec_id, r.score) for r in df.select("qid", "rank", "vec_id", "score").collect())
    assert rows(near) == rows(vector.knn(vec, ask, 5))
