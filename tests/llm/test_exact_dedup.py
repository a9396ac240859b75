"""Exact dedup against a plain dictionary, with tables so small that buckets are dealt on again and again."""

import hashlib
import os
import random

import pytest

from sievemark.llm import exact_dedup
from sievemark.llm.exact_dedup import OpenTable, settle

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = {}
    for i, (key, text) in enumerate(rows):
        text = text or ""
        groups.setdefault("".join(c for c in text if c not in SPACE), []).append((-len(text), key is None, key or 0, i))
    out = []
    for text, own in groups.items():
        stays = min(own)
        for _, null, key, i in own:
            out.append((None if null else key, None if stays[1] else stays[2], len(own), i == stays[3], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("ab \t é🙂") for _ in range(r.choice([0, 1, 3, 40, 400]))) for _ in range(n // 3)]
    rows = [(i if r.random() < 0.95 else None, r.choice(base + ["hot text"] * len(base) + [None, " ", "\r\n"])) for i in range(n)]
    spread = [(k, t if t is None or r.random() < 0.5 else t.replace("a", "a ", 1)) for k, t in rows]
    return spread + r.sample(spread, n // 10) + [(n + 1, "long " * 60000), (n + 2, "long" * 60000), (n + 3, "long" * 60000 + "!")]


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("table_bytes,buckets", [(exact_dedup.TABLE_BYTES, None), (300, 1), (1, 2)])
def test_against_plain(spark, table_bytes, buckets):
    rows = corpus(table_bytes, 400)
    df = spark.createDataFrame([(k, t, 0, "x", None) for k, t in rows], "doc_id long, text string, g int, content string, row long").repartition(5)
    got = found(exact_dedup.exact_dedup(df, table_bytes=table_bytes, buckets=buckets))
    # rows that repeat another whole can stay for each other
    assert got == brute(rows)


def test_no_rows(spark):
    out = exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == [] and out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_string_keys(spark):
    got = found(exact_dedup.exact_dedup(spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "x\ty"), ("c", "xy")], "doc_id string, text string")))
    want = hashlib.sha256(b"xy").hexdigest()
    assert got == sorted([("b", "a", 4, False, want), ("a", "a", 4, True, want), (None, "a", 4, False, want), ("c", "a", 4, False, want)], key=repr)


def test_equal_hashes():
    """Texts whose hashes are equal are told apart by their content, in the table and through every spill."""
    table = OpenTable()
    for i in range(3000):
        assert table.find(7, b"%d" % i) == -1
        table.add(7 if i < 50 else i, b"%d" % i, i)
    assert [table.find(7 if i < 50 else i, b"%d" % i) for i in range(3000)] == list(range(3000))


@pytest.mark.parametrize("limit", [1, 8, 100, 10**6])
def test_spills(tmp_path, limit):
    r = random.Random(limit)
    texts = [b"%d" % r.randrange(300) for _ in range(1000)]
    hashes = {t: (5 if len(t) < 3 else r.getrandbits(64) - (1 << 63)) for t in texts}
    want, names = [], {}
    for g, t in enumerate(texts):
        if names.setdefault(t, g) != g:
            want.append((g, names[t]))
    folder = f"file://{tmp_path}/spill"
    got = settle(((g, hashes[t], t) for g, t in enumerate(texts)), folder, limit)
    seen = 0
    pairs = []
    for x in got:
        pairs.append(x)
        seen = max(seen, len(os.listdir(tmp_path / "spill"))) if (tmp_path / "spill").exists() else seen
    assert sorted(pairs) == want
    assert (seen > 0) == (limit < 1000) and (not seen or os.listdir(tmp_path / "spill") == [])
