"""Ranked search against plain scoring of every document, and the bounds that leave subtrees out."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sievemark.llm import ball_tree
from sievemark.llm.ball_tree import BallTree, Best, Trees


def terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)


def brute(docs, items, top=10):
    seqs = [(k, Counter(terms(t))) for k, t in docs]
    seqs = [(k, c, sum(c.values())) for k, c in seqs if c]
    count, length = len(seqs), sum(n for _, _, n in seqs)
    out = []
    for item, text in items:
        scored = []
        for key, c, n in seqs:
            score = 0
            for t in set(terms(text)):
                if t in c:
                    df = sum(t in x for _, x, _ in seqs)
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * count // length)))
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, i + 1, None if null else key, -s) for i, (s, null, key) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def text(r, n):
    return r.choice([" ", ".", "_", "\n"]).join(r.choice(["Ä", "ä", "MIX", "mix", *(f"w{int(r.expovariate(0.08))}" for _ in range(4))]) for _ in range(n))


@pytest.mark.parametrize("seed,block_words", [(1, ball_tree.BLOCK_WORDS), (2, 12)])
def test_against_plain(spark, seed, block_words):
    r = random.Random(seed)
    docs = [(i, text(r, r.choice([0, 1, 5, 30, 90]))) for i in range(180)]
    docs += [(500 + i, "w1 w2 mix copy") for i in range(90)] + [(None, "w1 w2 mix copy"), (None, None), (900, None), (901, "w3 " * 20000 + "end"), (902, "!?"), *docs[:20]]
    items = [(f"q{i}", text(r, r.choice([1, 4, 12]))) for i in range(14)] + [("copies", "copy w1"), ("none", ""), ("null", None), ("odd", "nowhere"), (None, "w2 w2 mix"), ("long", text(r, 4000)), ("end", "end")]
    left = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in docs], "doc_id long, text string, no int, score int, rank int").repartition(4)
    right = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id string, text string, doc_id int")
    got = ball_tree.search(left, right, block_words=block_words)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("docs,items", [([], [("a", "w1")]), ([(1, "w1")], []), ([(1, None)], [("a", "w1")]), ([(1, "w1")], [("a", None)])])
def test_without_rows(spark, docs, items):
    got = ball_tree.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert got.collect() == []


def vectors(seed, n, width, centres):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        own = rng.integers(0, width, 12) if centres == 0 else (rng.integers(0, 12, 9) + 40 * (i % centres))
        ids = np.unique(own)
        rows.append((ids, rng.integers(0, 10**6, len(ids)) if centres == 0 else 900_000 + rng.integers(0, 1000, len(ids))))
    return rows


def built(rows):
    ptr = np.cumsum([0, *(len(x) for x, _ in rows)])
    return BallTree(ptr, np.concatenate([x for x, _ in rows]), np.concatenate([v for _, v in rows]))


@pytest.mark.parametrize("centres", [0, 8])
def test_bounds_hold(centres):
    rows = vectors(centres, 700, 400, centres) + [(np.array([3]), np.array([0]))] * 40
    tree, rng = built(rows), np.random.default_rng(9)
    for _ in range(20):
        asked = np.unique(rng.integers(0, 420, 15))
        weights = rng.integers(0, 9000, len(asked))
        dense = np.zeros(500, np.int64)
        dense[asked] = weights
        here = np.isin(asked, tree.terms)
        bound = tree.bounds(np.searchsorted(tree.terms, asked[here]), weights[here])
        for node, (a, b, _) in enumerate(tree.nodes):
            assert all(int(dense[rows[i][0]] @ rows[i][1]) <= bound[node] for i in tree.order[a:b])


def test_subtrees_left_out():
    """Documents of eight topics: a question on one reads few leaves, and its result is that of scoring all."""
    rows, asked = vectors(8, 4000, 0, 8), np.arange(80, 92)
    weights = np.full(12, 5000)
    trees = Trees([(asked, weights)], 10, docs=2000)
    for i, (ids, values) in enumerate(rows):
        trees.add(i, ids, values)
    trees.flush()
    dense = np.zeros(400, np.int64)
    dense[asked] = weights
    want = sorted((-int(dense[ids] @ v), i) for i, (ids, v) in enumerate(rows))[:10]
    assert [(s, k) for s, _, k in trees.best[0].rows] == want
    assert trees.leaves < trees.all_leaves / 3


def test_best_of_ties():
    best = Best(3)
    for keys in ([7, None, 5], [6, 1, None]):
        best.add(keys, np.array([4, 4, 4]), np.arange(3))
    assert best.rows == [(-4, False, 1), (-4, False, 5), (-4, False, 6)]
    assert best.add([9], np.array([0]), np.array([0])) == 4
