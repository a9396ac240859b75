"""Quality, licences and substring dedup: held-out accuracy, brute force and odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from sievemark.llm import licenses, quality, substring_dedup
from sievemark.llm.license_texts import TEMPLATES
from sievemark.llm.queries import op7_quality

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in op7_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [x for x in labels if x.quality is not None and got[x.doc_id].held_out]
    assert sum(got[x.doc_id].predicted == x.quality for x in held) >= 0.97 * len(held)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", "x"), (2, "bad$$$ words$$$", "y"), (3, None, None), (3, None, None), (None, "good words", "z"), (4, "", "q"), (5, "w" * 200_000, "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (9, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model, carry=True)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 7
    blank = {r.score for r in out.collect() if not r.text}
    assert len(blank) == 1
    nothing = quality.fit(docs.limit(0), labels)
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_training_sample_is_bounded(spark):
    """A labelled document that repeats counts once, and no more rows are fitted on than the bounds allow."""
    docs = spark.createDataFrame([(i, f"word{i} more words", 1) for i in range(40)] + [(7, "word7 more words", 2)] * 500 + [(7, "another text of the key", 3)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = docs.where("y = 1 and doc_id <> 7").unionByName(spark.createDataFrame([(7, "another text of the key", 3)], "doc_id long, text string, y int"))
    a, b = quality.fit(docs, labels), quality.fit(once, labels)
    assert (a.weight == b.weight).all() and a.bias == b.bias
    few = quality.fit(docs, labels, most_counts=60)
    assert 0 < (few.weight != 0).sum() <= 60 < (a.weight != 0).sum()


def test_descent_against_plain_steps():
    """The trainer's steps, said plainly over dense counts of a tiny corpus."""
    import numpy as np

    docs, labels = [[1, 1, 2], [3, 4], [2, 3, 3, 5], []], np.array([1, 0, 1, 0])
    found = [np.unique(np.array(d, np.int64), return_counts=True) for d in docs]
    model = quality.train(np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found]), np.array([len(f) for f, _ in found]), labels, dim=3, epochs=4, batch=2, rate=0.5, seed=3)
    rng = np.random.default_rng(3)
    used = sorted({x for d in docs for x in d})
    vec = rng.uniform(-1 / 3, 1 / 3, (len(used), 3)).astype(np.float32).astype(float)
    out, bias = rng.normal(0, 0.3, (3, 2)).astype(np.float32).astype(float), np.zeros(2)
    step = 0
    for _ in range(4):
        order = rng.permutation(4)
        for at in (0, 2):
            lr = 0.5 * (1 - step / 8)
            step += 1
            old_vec, old_out, d_out, d_bias, moves = vec.copy(), out.copy(), np.zeros_like(out), np.zeros(2), []
            for i in order[at : at + 2]:
                x = np.array([docs[i].count(u) for u in used]) / max(1, len(docs[i]))
                mean = x @ old_vec
                p = np.exp(mean @ old_out + bias)
                p /= p.sum()
                p[labels[i]] -= 1
                g = p / 2
                d_out += np.outer(mean, g)
                d_bias += g
                moves.append(np.outer(x, g @ old_out.T) * 2)
            out = old_out - lr * 0.1 * d_out
            bias = bias - lr * 0.1 * d_bias
            vec = old_vec - lr * sum(moves)
    assert np.allclose(model.weight[used], vec @ (out[:, 1] - out[:, 0]), atol=1e-4) and abs(model.bias - (bias[1] - bias[0])) < 1e-4
    words = quality.words_of(b"good good words here")
    by_hand = model.bias + np.mean(model.weight[quality.features(words)[0]])
    assert abs(quality.Scorer(model).scores([b"good good words here"])[0] - 1 / (1 + np.exp(-by_hand))) < 1e-6


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 20))] for _ in range(2))
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) <= lcs(a, b)
    distinct = rng.sample(range(100), 30)
    other = [x for x in distinct if x % 3] + [200]
    assert len(licenses.patience(distinct, other)) == lcs(distinct, other)


def test_license_scan_against_every_window(spark):
    """Where a short template stands, by trying every window of its stretched length: found just there."""
    rng = random.Random(21)
    template = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    words = template.split()
    for _ in range(60):
        text = [rng.choice(["x", "y", *words[:3]]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            own = [w for w in words if rng.random() > 0.15]
            at = rng.randint(0, len(text))
            text[at:at] = own
        best = max((lcs(text[i : i + 15], words) for i in range(len(text))), default=0)
        found = licenses.Scanner({"T": template}).scan(" ".join(text))
        assert bool(found) <= (best >= 8)
        if found:
            assert all(0.8 <= f[3] <= best / 10 for f in found)
        elif best >= 8:  # only a repeated word can keep patience from an alignment that long
            assert len(set(text)) < len(text)


def test_licenses(spark):
    mit = TEMPLATES["MIT"].split()
    noisy = " ".join(w for i, w in enumerate(mit) if i % 10)
    texts = ["Intro the and of. Released under the MIT License.\nmore", f"x {TEMPLATES['Apache-2.0']} y", noisy, "license under the mit released", None, "", "Released under the MIT License. Released under the MIT License.", " ".join(reversed(mit)), "The the of and software " * 3000 + TEMPLATES["ISC"]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs, TEMPLATES).collect()}
    assert len(got) == len(texts) + 1
    assert got[0].licenses == "MIT-notice" and got[0].found[0].coverage == 1.0 and texts[0][got[0].found[0].start : got[0].found[0].end] == "Released under the MIT License"
    assert got[1].licenses == "Apache-2.0,Apache-2.0-notice" and got[1].best == "Apache-2.0"
    assert got[2].licenses == "MIT" and 0.85 <= got[2].best_coverage <= 0.95
    assert [got[i].n_licenses for i in (3, 4, 5, 7)] == [0, 0, 0, 0] and got[4].best is None
    assert len(got[6].found) == 2 and got[6].n_licenses == 1
    assert got[8].licenses == "ISC,ISC-permission" and got[None].licenses == "MIT-notice"
    odd = spark.createDataFrame([(1, "word of software " * 100_000 + TEMPLATES["BSD-3-Clause"], 9, "x"), (1, None, 9, "x"), (1, None, 9, "x")], "doc_id long, text string, n_licenses int, best string")
    assert sorted((r.n_licenses, r.best) for r in licenses.license_scan(odd, TEMPLATES).select("n_licenses", F.coalesce("best", F.lit("")).alias("best")).collect()) == [(0, ""), (0, ""), (3, "BSD-2-Clause")]  # it holds the shorter one whole, and ties go to the first name
    assert licenses.license_scan(docs, {}).where("n_licenses > 0").count() == 0
    assert licenses.license_scan(docs.limit(0), TEMPLATES).count() == 0


def brute_dedup(rows, least=20):
    """Cuts the sentences of every run that an earlier (key, sentence) place has, by comparing words themselves."""
    first = {}
    docs = []
    for k, t in rows:
        where = substring_dedup.sentences(t or "")
        words = [tuple(t[a:b].lower().split()) for a, b in where]
        found = set()
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                n = [len(w) for w in words[i:j]]
                if sum(n) >= least and (sum(n[:-1]) < least or sum(n[1:]) < least):
                    forward, backward = sum(n[:-1]) < least, sum(n[1:]) < least
                    if forward or backward:
                        found.add((i, j))
        docs.append((k, t, where, words, found))
        for i, j in found:
            run, at = tuple(words[i:j]), ((k is not None, k or 0), t, i)
            if run not in first or at[::2] < first[run][::2]:
                first[run] = at
    out = []
    for k, t, where, words, found in docs:
        gone = {s for i, j in found if (first[tuple(words[i:j])][0], first[tuple(words[i:j])][2]) != ((k is not None, k or 0), i) for s in range(i, j)}
        out.append((k, len(where), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [400_000, 5])
def test_substring_dedup(spark, monkeypatch, chunk):
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([1, 3, 8, 15, 25]))).capitalize() + rng.choice([".", "!", "?", "\n"])
    shared = [say() for _ in range(12)]
    rows = []
    for k in range(50):
        parts = [say() for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.6:
            a = rng.randint(0, 8)
            parts[rng.randint(0, len(parts)) : 0] = shared[a : a + 4]
        rows.append((100 - k, " ".join(parts)))
    rows += [(200, None), (201, ""), (None, rows[0][1]), (202, " ".join(shared * 3)), (203, "no end " * 30)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, n_removed string").repartition(3)
    monkeypatch.setattr(substring_dedup, "CHUNK_RUNS", chunk)
    got = substring_dedup.substring_dedup(df)
    assert got.columns == ["doc_id", "text", "n_sentences", "n_removed", "removed"]
    have = got.collect()
    assert sorted(((r.doc_id, r.n_sentences, r.n_removed) for r in have), key=str) == brute_dedup(rows)
    old = dict(rows)
    for r in have:
        cut = list(zip(r.removed[::2], r.removed[1::2]))
        if old[r.doc_id] is None:
            assert r.text is None
        else:
            assert r.text == "".join(c for i, c in enumerate(old[r.doc_id]) if not any(a <= i < b for a, b in cut))
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30)) + "."
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()) == [(1, 0), (1, 0), (2, 1)]
