"""Hard negatives against scoring of all pairs, and the intervals that decide what is scored."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import hard_negatives
from sievemark.llm.hard_negatives import Anchors, Stripe, encode, negatives, positives, products

KIND = "vec_id long, embedding array<float>, label string, id int, score long, d int"


def brute(rows, step=10):
    fine = []
    for key, x, label in rows:
        if key is not None and label is not None and x and all(c is not None and math.isfinite(c) for c in x):
            fine.append((key, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = []
    for key, x, label in fine:
        if key % step:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), other, own) for other, y, own in fine if other != key and len(y) == len(x)]
        near = sorted(s for s in scored if s[2] == label)[:5]
        for p, positive, _ in near:
            fits = sorted(s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out += [(key, positive, i + 1, n, -p, -s) for i, (s, n, _) in enumerate(fits)]
    return sorted(out)


def corpus(seed, n=260, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = [(i, (centres[rng.integers(5)] + rng.normal(size=d) * rng.choice([0.05, 0.4, 1.5])).tolist(), "abc"[rng.integers(3)]) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot, "ab"[i % 2]) for i in range(130)]
    rows += [(1000, None, "a"), (1010, [], "a"), (1020, [0.0] * d, "a"), (1021, [0.0] * d, "b"), (1030, [1.0] * d, None), (None, [1.0] * d, "a"), (1040, [float("nan")] + [1.0] * (d - 1), "a"), (1050, [float("inf")] * d, "a"), (1060, [None] + [1.0] * (d - 1), "b")]
    rows += [(1100 + i, [1.0 + i % 2, 0.5, -0.25], "ab"[i % 2]) for i in range(12)] + [(1200, [0.5], "a"), (1210, [-3.0], "b"), (1211, [-2.5], "a"), (1300, [0.01] * 4000, "a"), (1301, [0.02] * 4000, "a"), (1302, [0.016] * 4000, "b")]
    return rows


@pytest.mark.parametrize("seed,stripe_rows,block_anchors", [(1, hard_negatives.STRIPE_ROWS, hard_negatives.BLOCK_ANCHORS), (2, 40, 7)])
def test_against_all_pairs(spark, seed, stripe_rows, block_anchors):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KIND)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, stripe_rows=stripe_rows, block_anchors=block_anchors)
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


@pytest.mark.parametrize("rows", [[], [(1, [1.0], "a")], [(10, [1.0], "a"), (11, [1.0], "a")], [(10, None, "a")]])
def test_without_partners(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KIND)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("d", [1, 7, 64, 100])
def test_intervals_hold(d):
    rng = np.random.default_rng(d)
    rows = np.floor(256 * np.concatenate([rng.normal(size=(300, d)), np.zeros((2, d)), np.ones((2, d)), rng.normal(size=(50, d)) * 1e-2, np.eye(d)[:1] * 1e4])).astype(np.int64)
    asked = np.concatenate([rows[:20], rows[-60:], -rows[:5]])
    codes, anchors = encode(rows), Anchors(asked)
    for i, x in enumerate(asked):
        low, high = anchors.interval(i, codes, np.arange(len(rows)))
        exact = rows @ x
        assert (low <= exact).all() and (exact <= high).all()


def held_rows(rows, label):
    return Stripe(ids=np.arange(len(rows)), label=label, whole=rows, **encode(rows))


def test_few_are_scored():
    """Close groups: most rows are left out by their codes alone."""
    rng = np.random.default_rng(5)
    rows = np.floor(256 * (np.repeat(rng.normal(size=(40, 64)), 100, 0) + rng.normal(size=(4000, 64)) * 0.02)).astype(np.int64)
    held, seen = held_rows(rows, np.arange(4000) % 2), []
    got = list(positives(held, held.ids[:5], held.label[:5], rows[:5], seen=seen))
    assert len(got) == 25 and sum(a for a, _ in seen) < 0.2 * sum(b for _, b in seen)
    asked, seen = np.array([(a, s) for a, _, s in got]), []
    assert list(negatives(held, held.ids[:5], held.label[:5], rows[:5], asked, seen=seen))
    assert sum(a for a, _ in seen) < 0.2 * sum(b for _, b in seen)


def test_large_products():
    assert products(np.array([[1 << 40, 1]]), np.array([1 << 21, 5])).tolist() == [(1 << 61) + 5]
    with pytest.raises(ValueError):
        products(np.array([[1 << 40]]), np.array([1 << 40]))
