"""The greedy pass against a plain loop."""

import random

import pytest

from sievemark.operators import fusion
from sievemark.operators.fusion import kept_leaders, near_kept


def plain(pairs):
    before = {}
    for a, b in pairs:
        before.setdefault(b, set()).add(a)
    leader = {}
    for x in sorted({x for p in pairs for x in p}):
        kept = [a for a in before.get(x, ()) if leader[a] == a]
        leader[x] = min(kept) if kept else x
    return leader


@pytest.mark.parametrize("pairs", [[], [(1, 2), (2, 3), (3, 4), (4, 5), (1, 5)], [(i, i + 1) for i in range(9)], *[[tuple(sorted(random.Random(s).sample(range(20), 2))) for s in range(k, k + 30)] for k in (0, 100, 200)]])
def test_rounds(spark, pairs):
    got = kept_leaders(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.leader for r in got.collect()} == plain(pairs)


def test_rows(spark):
    """A paragraph extended a little is a near-duplicate, and so is what extends the dropped one; another one isn't."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, "s", words), (2, "s", words + ["x"] * 4), (3, "s", words + ["x"] * 4 + [f"y{i}" for i in range(12)]), (4, "s", words), (5, "s", words + ["x"] * 4), (6, "t", words), (7, "s", words[:10]), (8, "s", [f"v{i}" for i in range(60)]), (9, "s", None)]
    got = {r.doc_id: (r.kept, r.leader) for r in near_kept(spark.createDataFrame(rows, "doc_id long, source string, tokens array<string>")).collect()}
    # 3 is near to 2, which went; it isn't near to 1
    assert got == {1: (True, 1), 2: (False, 1), 3: (True, 3), 4: (False, 1), 5: (False, 1), 6: (True, 6), 7: (True, 7), 8: (True, 8), 9: (True, 9)}


def test_shuffles_hold_prefixes_only(spark, monkeypatch):
    """Each set is written once; what is shuffled of it is its rarest shingles, and itself only where it may link (F4)."""
    rng = random.Random(4)
    rows = [(i, "s", [f"w{rng.randrange(10**6)}" for _ in range(60)]) for i in range(60)]
    rows += [(100 + i, "s", rows[i][2][:58] + [f"x{i}"] * 2) for i in range(5)] + [(200, None, rows[0][2]), (201, None, rows[0][2]), (202, None, rows[0][2][:58] + ["y", "y"])]
    named, sent = [], []
    write, few = fusion.checkpointed, fusion._few
    monkeypatch.setattr(fusion, "checkpointed", lambda df: named.append(write(df)) or named[-1])
    monkeypatch.setattr(fusion, "_few", lambda df: sent.append(df.count()) or few(df))
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens array<string>")
    got = {(r.a, r.b): r.jaccard for r in fusion.near_duplicates(docs).collect()}
    # rows without a group pair with copies only
    assert set(got) == {(i, 100 + i) for i in range(5)} | {(200, 201)} and got[(0, 100)] == round(54 / 58, 6)
    assert sum("s" in df.columns for df in named) == 1
    # copies, and the two sets of each of five pairs
    assert sent == [1, 10]


def test_pairs_against_counting(spark, monkeypatch):
    """All pairs with their similarity, over small blocks and whether copies or firsts or neither are broadcast."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = list(rng.choice(rows)[2]) if rows and rng.random() < 0.8 else [f"w{rng.randrange(300)}" for _ in range(rng.choice([20, 60, 400]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
        rows.append((i, rng.choice("st"), words))
    sets = {i: (g, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))) for i, g, w in rows}
    first = {}
    for i, v in sets.items():
        first.setdefault(v, i)
    want = {(first[v], i): 1.0 for i, v in sets.items() if first[v] != i}
    reps = sorted(first.values())
    for j in reps:
        for i in (k for k in reps if k < j and sets[k][0] == sets[j][0]):
            both, common = len(sets[i][1]) + len(sets[j][1]), len(sets[i][1] & sets[j][1])
            if 100 * common >= 82 * (both - common):
                want[(i, j)] = round(common / (both - common), 6)
    assert sum(j < 1 for j in want.values()) > 20 and sum(j == 1 for j in want.values()) > 10
    docs = spark.createDataFrame(rows, "doc_id int, source string, tokens array<string>")
    for block, most in ((1024, 500_000), (4, 30), (2, 0)):
        monkeypatch.setattr(fusion, "BLOCK_SETS", block)
        monkeypatch.setattr(fusion, "MOST_BROADCAST", most)
        assert {(r.a, r.b): r.jaccard for r in fusion.near_duplicates(docs).collect()} == want
