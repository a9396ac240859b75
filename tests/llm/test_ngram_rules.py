"""The n-gram join at other shingle sizes and thresholds, and the pipeline's near_duplicates stage by its own rule."""

import random
import re

import corpus_pipeline as cp
import pytest

from sievemark.llm import ngram_join
from sievemark.llm.ngram_join import ngram_components
from test_ngram_join import ODD, corpus

SF = "/root/testdata/sf0.001"


def brute(rows, size, num, den):
    """(key, component) of every row with a key, over all pairs."""
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
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                up[max(x, y)] = min(x, y)
    return sorted((k, root(k)) for k, _ in rows if k is not None)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def got(spark, rows, **how):
    return sorted((r.doc_id, r.component_id) for r in ngram_components(frame(spark, rows), **how).where("doc_id is not null").collect())


@pytest.mark.parametrize("size, num, den", [(5, 80, 100), (2, 1, 2)])
def test_other_rules(spark, size, num, den):
    rows = corpus(5) + ODD
    want = brute(rows, size, num, den)
    assert got(spark, rows, size=size, num=num, den=den) == want != brute(rows, 3, 90, 100)


def test_other_rule_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    rng = random.Random(7)
    rows = [(0, " ".join(f"w{i}" for i in range(90)))]
    for i in range(1, 80):
        w = rows[rng.randrange(max(0, i - 12), i)][1].split()
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert got(spark, rows, block_sets=8, size=5, num=80, den=100) == brute(rows, 5, 80, 100)


def test_stage_links_by_five_words(spark):
    """Two changed words of 102: 88/108 by five words is a link, 94/106 by three isn't one at 0.9."""
    w = [f"w{i}" for i in range(102)]
    near = [x if i not in (30, 70) else "other" + x for i, x in enumerate(w)]
    far = [x if i not in (20, 50, 80) else "third" + x for i, x in enumerate(w)]
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far))]
    assert sorted(r.doc_id for r in cp.one_of_each_group(spark, frame(spark, rows), SF).collect()) == [1, 3]


def test_stage_against_brute_force(spark):
    rows = corpus(6) + [(k, t) for k, t in ODD if k is not None and k != 5003] + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id between 10000 and 10300 or doc_id < 300").collect()]
    rows = list({k: (k, t) for k, t in rows}.values())
    stay = sorted(r.doc_id for r in cp.one_of_each_group(spark, frame(spark, rows), SF).collect())
    assert stay == [k for k, c in brute(rows, 5, 80, 100) if k == c]
