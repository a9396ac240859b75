"""BM25 is counted and summed where a document is read; nothing is shuffled for it, and bounds drop no row of the first."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemark.functions.text import search_tokens
from sievemark.jobs import registry
from sievemark.operators import lexical, relational

SF = "/root/testdata/sf0.001"
DOCS = [(1, "The U.S. net-sales, 1,234.50% (of) R&D."), (2, None), (3, ""), (4, "NET net net 1234.50% the"), (5, "of the year"), (6, "u.s u.s. x é 12é ١٢ 5")]
ASKED = [(7, ["net", "u.s", "net"]), (8, ["1234.50%", "r&d"]), (9, []), (10, ["none"]), (11, ["5", "12", "net-sales"])]


def test_scores_shuffle_nothing(spark):
    plan = registry.QUERIES["lx03_bm25_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def brute(docs, asked):
    counts = {d: Counter(t or []) for d, t in docs}
    length = {d: sum(c.values()) for d, c in counts.items()}
    mean, n = max(1.0, sum(length.values()) / len(docs)), len(docs)
    df = Counter(t for c in counts.values() for t in c)
    part = lambda t, d: math.log(1 + max(0, (n - df[t] + 0.5) / (df[t] + 0.5))) * counts[d][t] * 2.4 / (counts[d][t] + 1.4 * (0.28 + 0.72 * length[d] / mean))
    return {(q, d): round(sum(part(t, d) for t in set(terms) if t in counts[d]), 6) for q, terms in asked for d in counts if set(terms) & set(counts[d])}


@pytest.mark.parametrize("rows,cells,pairs,words", [(200_000, 1, 1, 1), (200_000, 1 << 21, 1 << 20, 1 << 18), (0, 1, 1, 1)])
def test_scores(spark, monkeypatch, rows, cells, pairs, words):
    for module, name, value in ((relational, "MOST_ROWS", rows), (lexical, "_CELLS", cells), (lexical, "_PAIRS", pairs), (lexical, "_WORDS", words)):
        monkeypatch.setattr(module, name, value)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    want = brute([tuple(r) for r in docs.select("doc_id", search_tokens(F.col("text"))).collect()], ASKED)
    asked = spark.createDataFrame(ASKED, "qid int, terms array<string>")
    assert len(want) == 7 and {(r.qid, r.doc_id): r.score for r in lexical.bm25(docs, asked).collect()} == want
    also = spark.createDataFrame([(7, 1), (9, 2)], "qid int, doc_id long")
    assert {(r.qid, r.doc_id): r.score for r in lexical.bm25(docs, asked, also=also).collect()} == {**want, (9, 2): 0.0}


def test_bound_keeps_the_first(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_CELLS", 20)
    docs = spark.createDataFrame([(i, " ".join(["net"] * (i % 7) + ["sales"] * (i % 3) + [f"w{i}"] * (i % 11))) for i in range(300)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, ["net", "sales"]), (2, ["net"]), (3, ["w5"])], "qid int, terms array<string>")
    gain = F.col("doc_id") % 5 * 0.1

    def ranked(**more):
        scored = lexical.bm25(docs, asked, **more)
        return scored.count(), sorted(map(tuple, lexical.rank_boosted(scored.withColumn("boost", gain), 10).select("qid", "doc_id", "bm25_score", "bm25_rank").collect()))

    (all_, want), (some, got) = ranked(), ranked(first=(10, 0.4))
    assert got == want and len(want) == 21 and some < all_
