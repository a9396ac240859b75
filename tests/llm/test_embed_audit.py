"""The audit of a shard's search: it passes on true links only, and where there are too few the block is compared whole."""

import numpy as np
import pytest

from sievemark.llm import embed_dedup
from sievemark.llm.hnsw import Graph


class Blind:
    """A graph whose search finds nothing but the query itself, at any beam."""

    def __init__(self, x):
        self.x = x

    def near(self, queries, least, ef):
        return [np.flatnonzero((self.x == q).all(1)) for q in queries]


def shard(pairs, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 32))
    for a, b in pairs:
        x[b] = x[a] + rng.normal(size=32) * 0.01
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("diagonal", [True, False])
def test_sparse_links(diagonal):
    pairs = [(i, i + 700) for i in range(1, 600, 60)]
    x = shard(pairs)
    ids = np.arange(len(x))
    ask, own = (x, ids) if diagonal else (x[:700], ids[:700])
    exact, names = (x, ids) if diagonal else (x[700:], ids[700:])
    found = embed_dedup.find_links(Blind(exact), exact, ask, 0.93, names, own)
    want = {(a, b) for a, b in pairs} | ({(b, a) for a, b in pairs} if diagonal else set())
    assert {(int(own[i]), int(names[j])) for i, f in enumerate(found) for j in f} == want


@pytest.mark.parametrize("blind", [True, False])
def test_dense_links(blind):
    x = shard([(i // 10 * 10, i) for i in range(1500) if i % 10])
    ids = np.arange(len(x))
    found = embed_dedup.find_links(Blind(x) if blind else Graph(x), x, x, 0.93, ids, ids)
    got = {(i, int(j)) for i, f in enumerate(found) for j in f}
    want = {(i, j) for i in range(1500) for j in range(i // 10 * 10, i // 10 * 10 + 10) if i != j}
    assert got == want if blind else got <= want and len(got) >= 0.995 * len(want)
