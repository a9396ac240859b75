"""The n-gram join against brute force: random near copies, large groups over small blocks, and odd rows."""

import random
import re

import pytest

from sievemark.llm import ngram_join
from sievemark.llm.ngram_join import ngram_components


def brute(rows, size=3):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = {k: k for k, _ in rows if k is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 90 * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                up[max(x, y)] = min(x, y)
    return sorted(((k, len(s), None if k is None else root(k)) for (k, _), s in zip(rows, sets)), key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(k, t, "c1", 7) for k, t in rows], "doc_id long, text string, c1 string, n int").repartition(3)
    return sorted((tuple(r) for r in ngram_components(df, **how).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, n=160, words=40):
    rng = random.Random(seed)
    common = " ".join(rng.choice("abcdefgh") for _ in range(30))
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.6:
            w = rng.choice(rows[-40:])[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if w:
                    w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
            t = " ".join(w)
        else:
            t = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 8, words, 3 * words])))
            if kind > 0.85:
                t = common + " " + t
        rows.append((1000 - i, t))
    return rows


ODD = [(5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "one"), (5005, "one two"), (None, "one"), (5006, "É x\x0by"), (5007, "é x y"), (5008, "A a A a A a"), (5009, "a a a a a"), (5003, "One")]


def test_random(spark):
    rows = corpus(1) + ODD
    assert got(spark, rows) == brute(rows)


def test_many_small_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 32)
    rows = corpus(2) + ODD
    assert got(spark, rows, group_tokens=100) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_large_components_over_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):  # a chain that drifts away from where it began
        w = rows[rng.randrange(max(0, i - 12), i)][1].split()
        for _ in range(rng.choice([1, 1, 2])):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert got(spark, rows, block_sets=8) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_divide_skip_against_counts():
    """Every member that enough lists hold, with how many hold it; long lists, ties and empty lists among them."""
    from collections import Counter

    rng = random.Random(12)
    for _ in range(400):
        n = rng.randint(1, 14)
        lists = [sorted(rng.sample(range(40), rng.choice([0, 1, 3, 8, 30]))) for _ in range(n)]
        t = rng.randint(1, n)
        want = sorted((x, c) for x, c in Counter(x for own in lists for x in own).items() if c >= t)
        assert list(ngram_join.divide_skip(lists, t)) == want


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short text of five words"), (3, "short text of five words")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, n_shingles int, component_id int, comp string")
    got = sorted(map(tuple, ngram_components(df).collect()))
    assert got == [(1, 59_998, 1), (2, 59_999, 1), (3, 3, 3), (3, 3, 3)]


def near_copies(seed, n=300, words=120, most=40):
    """Sets of one group of near copies: many link with most of the group, many with none of it."""
    import numpy as np

    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, words, np.uint64)
    sets = []
    for _ in range(n):
        s, k = base.copy(), int(rng.integers(0, most))
        s[rng.choice(words, k, False)] = rng.integers(0, 2**64, k, np.uint64)
        sets.append(np.unique(s))
    return sets


def test_what_cannot_link_is_not_merged(monkeypatch):
    """The sets of a large group that surely don't link aren't merged and probed pair by pair (F2)."""
    from sievemark.llm.common import Forest

    asked, plain = [], ngram_join.divide_skip
    monkeypatch.setattr(ngram_join, "divide_skip", lambda lists, t: asked.append(sum(map(len, lists))) or plain(lists, t))
    for num, seed in ((80, 1), (90, 2)):
        asked.clear()
        sets = near_copies(seed)
        forest, want = Forest(len(sets)), Forest(len(sets))
        ngram_join.search(sets, forest, num, 100)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if ngram_join.linked(ngram_join.overlap(a, b), len(a), len(b), num, 100):
                    want.join(i, j)
        assert [forest.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]
        assert len({want.root(i) for i in range(len(sets))}) > 50
        # before: 2.3 and 1.5 million
        assert sum(asked) < 200_000


def test_loose_ties_hold_every_link(monkeypatch):
    """Loose components of a group join all that links, on short lists and long ones, and hardly what doesn't (F1)."""
    import numpy as np
    import pyarrow as pa

    for most in (2, 8, 32):
        monkeypatch.setattr(ngram_join, "LIST_PAIRS", most)
        monkeypatch.setattr(ngram_join, "BLOCK_PAIRS", 50)
        sets = near_copies(3) + near_copies(4, 40, 300, 60) + near_copies(5, 40, 3, 2)
        maps = [ngram_join.bit_map(s, ngram_join.cells_of(len(s), 80, 100)).tobytes() for s in sets]
        # every shingle is on a list, so all pairs that share one meet
        group = pa.table({"c1": pa.array(range(len(sets))), "n": pa.array([len(s) for s in sets]), "cells": maps, "rare": [s.tobytes() for s in sets]})
        out = ngram_join._loose(group, 80, 100)
        from sievemark.llm.common import Forest

        loose, real = Forest(len(sets)), Forest(len(sets))
        for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist()):
            assert loose.join(a, b)  # a forest: no edge twice
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if ngram_join.linked(ngram_join.overlap(a, b), len(a), len(b), 80, 100):
                    real.join(i, j)
                    assert loose.root(i) == loose.root(j)
        parts = [len({f.root(i) for i in range(len(sets))}) for f in (loose, real)]
        assert parts[1] * 0.7 <= parts[0] <= parts[1]


def test_bit_maps_never_overstate():
    """The bits in which two maps differ are at most the sets' difference, at any two lengths of maps."""
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 400)), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**64, int(rng.integers(1, 60)), np.uint64)]))
        cells = [1 << int(rng.integers(6, 12)) for _ in range(2)]
        maps = ngram_join.BitMaps(np.array([len(a), len(b)]), [ngram_join.bit_map(x, c).tobytes() for x, c in zip((a, b), cells)], 80, 100)
        apart = len(a) + len(b) - 2 * ngram_join.overlap(a, b)
        assert maps.gap(0, np.array([1]))[0] <= apart
        if ngram_join.linked(ngram_join.overlap(a, b), len(a), len(b), 80, 100):
            assert maps.may_link(0, np.array([1]))[0]


def test_rarest_by_rank():
    """The same shingles as by sorting all of a set by rank, whatever part of it is known as frequent (F1)."""
    import numpy as np

    rng = np.random.default_rng(8)
    for part in (0, 0.1, 0.9, 1):
        s = np.unique(rng.integers(0, 2**64, 100, np.uint64))
        known = np.unique(np.concatenate([s[rng.random(len(s)) < part], rng.integers(0, 2**64, 9 if part else 0, np.uint64)]))
        ranks = rng.permutation(len(known))
        rank = np.array([dict(zip(known.tolist(), ranks.tolist())).get(x, -1) for x in s.tolist()])
        for k in (1, 20, len(s)):
            assert set(ngram_join.rarest(s, k, known, ranks).tolist()) == set(s[np.lexsort((s, rank))[:k]].tolist())


def test_only_members_texts_are_shuffled(spark, monkeypatch):
    """Texts of documents that can't link are joined to few members where they lie; many members still give all (F1)."""
    rows = corpus(9)
    want = brute(rows)
    plans, plain = [], ngram_join._with_texts
    monkeypatch.setattr(ngram_join, "_with_texts", lambda *a: plans.append(plain(*a)) or plans[-1])
    assert got(spark, rows) == want
    assert "strategy=broadcast" in plans[0]._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 0)
    assert got(spark, rows) == want


def test_texts_together():
    """Sets of texts whose words are hashed together are those of each alone, by words cut out one by one (F1)."""
    from sievemark.llm.shingles import Shingler

    texts = [(t or "").encode() for _, t in corpus(10) + ODD] + [b" ", b"\x0bx ", b"", b"a " * 40_000, "ü".encode() * 9, b"one two three"]
    shingler, calls = Shingler(3), []
    plain = shingler._words
    shingler._words = lambda text: calls.append(len(text)) or plain(text)
    got = [s.tolist() for s in shingler.sets_of(texts)]
    assert len(calls) < len(texts) / 5
    assert got == [Shingler(3).set_of(t).tolist() for t in texts]
    assert [len(s) for s in got] == [n for _, n, _ in sorted(((i, len({tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())), 0) for i, w in ((i, re.findall(rb"[^\x20\x09-\x0D]+", t.lower())) for i, t in enumerate(texts))))]
