"""Embedding links, token files and archives against brute force."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievemark.llm import embed_dedup, mph, token_files, warc
from sievemark.llm.common import components, new_folder
from sievemark.llm.hnsw import Graph

WORDS = P.path("word_bpe_49k.json")


def brute_embed(rows, least=0.93):
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and len(r[1]) and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n = [0] * len(rows)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    n[i] += 1
                    x, y = root(ids[i]), root(ids[j])
                    up[max(x, y)] = min(x, y)
    return sorted((i, k, root(i), i == root(i)) for i, k in zip(ids, n))


@pytest.mark.parametrize("shard_rows, stripe", [(8192, 8), (20, 8), (10, 2)])
def test_embed_dedup(spark, monkeypatch, shard_rows, stripe):
    monkeypatch.setattr(embed_dedup, "STRIPE", stripe)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        v = rng.normal(size=16)
        if i % 3 == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])
        rows.append((1000 - i, [float(x) for x in np.float32(v)], int(i % 2)))
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0] * 16, None), (2004, [1.0, None], 1), (2005, [], 1), (2006, [1.0], 1), (2007, [2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = embed_dedup.embed_dedup(df, shard_rows=shard_rows).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_embed(rows)


def test_embed_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.embed_dedup(df).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x[1000:2000] = x[0] + rng.normal(size=(1000, 32)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = x @ x.T >= 0.9
    found = Graph(x).near(x, 0.9, 32)
    assert sum(map(len, found)) >= 0.98 * truth.sum()
    again = Graph.load(Graph(x).dump()).near(x[:50], 0.9, 32)
    assert all((a == b).all() for a, b in zip(again, found))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7), (200, 201)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, 101, 102], 100), 200: 200, 201: 200, **dict.fromkeys(range(300, 330), 300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(4).integers(-(2**62), 2**62, 20000))
    index = mph.Index.view(mph.Index.of(np.repeat(keys, 2), 3, np.arange(1, 2 * len(keys) + 4)).dump())
    place, n = index.find(keys)
    assert (place == 3 + 2 * np.arange(len(keys))).all() and (n == 2).all()
    assert sorted(index.hash.slots(keys).tolist()) == list(range(len(keys)))
    assert (index.find(keys + 1)[0][~np.isin(keys + 1, keys)] == -1).all()
    assert index.find(keys[:0])[0].tolist() == [] and mph.Index.view(mph.Index.of(keys[:0], 1, np.array([4])).dump()).find(keys[:5])[1].sum() == 0


def test_token_files(spark):
    texts = ["Hello World", None, "", "a\tb\nc\r\nd  e", "É naïvé ́x   y z \x1c\x0b\x0c end", "<|endoftext|> x<|startoftext|>y", "ΣΑΣ Σ ςσΣ", "it's we'll 123 don''t " * 2000, "🙂👍🏽 中文字 ", "End. END., (end), é! é́, 5. 5), ½. <|EndOfText|>. <|endoftext|>. it's. it'. 'S, İ. ǅ, क़. '"]
    texts.append("long Words, here. " * 150_000 + "x" * 1_200_000)
    rows = [(90 - i, t) for i, t in enumerate(texts)] + [(None, "no key"), (None, "no key either"), (88, "of a key that is repeated"), (88, "again"), (88, "again")]
    tok = Tokenizer.from_file(WORDS)
    want, start = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, start int, ids string").repartition(3)
    back = sorted(token_files.digest(df, WORDS).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in back), key=str) == sorted(want, key=str)
    assert [r.doc_id or -1 for r in back] == sorted(r.doc_id or -1 for r in back)
    for r in back:
        assert r.start == start
        start += r.n_tokens
    manifest = token_files.write_ids(df, WORDS, new_folder(spark, "ids"))
    found = sorted((r.doc_id, r.ids) for r in token_files.lookup(manifest, spark.createDataFrame([(90,), (86,), (5,), (None,), (86,), (88,)], "doc_id long")).collect())
    assert found == sorted((k, tok.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in rows if k in (90, 86, 88))
    assert token_files.digest(df.limit(0), WORDS).count() == 0


def test_words_alone_and_together():
    tok = Tokenizer.from_file(WORDS)
    import duckdb

    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for most in (token_files.MOST_CACHE_BYTES, 100_000):
        enc = token_files.WordEncoder(open(WORDS, "rb").read(), "<u2", most)
        for part in (texts[:70], texts[70:], texts[:150]):
            assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(part)] == [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]
        assert enc.held <= most and sum(190 + len(w) + len(b) for d in (enc.new, enc.old) for w, b in d.items()) <= 1.1 * most


def test_words_at_random():
    tok, rng = Tokenizer.from_file(WORDS), np.random.default_rng(9)
    bits = list("ab|<>.,;!?'\"09éÉ İſßΣ\u0301\u200d中🙂\x0b\x1c\xa0\u2028") + ["<|startoftext|>", "'s", "|>", "end", "<|", "ll"]
    texts = ["".join(rng.choice(bits, 40)) for _ in range(3000)] + [" ".join(rng.choice(bits, 60)) for _ in range(1000)]
    enc = token_files.WordEncoder(open(WORDS, "rb").read(), "<u2")
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_warc(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 300000, "<p>a</p>", "x\r\n\r\ny"]
    rows = [(i, f"http://h/{i}\r\nX: 1", h) for i, h in enumerate(html)] + [(None, None, "<p>a</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: tuple(r)[1:] for r in warc.digest(df).collect()}
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    last = {h or "": i for i, h in enumerate(html)}
    want = {i: (len((h or "").encode()), digest(h), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, h in enumerate(html)}
    assert got == {**want, None: (8, digest("<p>a</p>"), "response", None)}
    assert warc.digest(df.limit(0)).count() == 0
    folder = new_folder(spark, "warc")
    warc.write_warc(df, folder, least_revisit_bytes=9)
    back = warc.read_warc(spark, folder)
    assert back.where("record_type = 'revisit'").count() == 0
    one = back.where("record_id = '<urn:record:5>' and record_type = 'response'")
    assert "BatchScan" in one._jdf.queryExecution().toString()
    assert bytes(one.first().payload).decode() == "é" * 300000 and one.count() == 1
    assert back.where("headers['warc-target-uri'] like '%h/1%'").count() == 1
    assert warc.read_warc(spark, folder, payload=False).where("payload is not null").count() == 0


def test_warc_odd_rows(spark):
    """Repeated rows with the largest key are each a response; columns with names of the records' aren't read."""
    df = spark.createDataFrame([(2, "u", "<p>", "x", 7), (2, "u", "<p>", "x", 7), (1, "u", "<p>", "x", 7), (3, None, "y" * 3_000_000, "x", 7)], "page_id long, url string, html string, record_type string, d int")
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.digest(df).collect()) == [(1, 3, "revisit", 2), (2, 3, "response", None), (2, 3, "response", None), (3, 3_000_000, "response", None)]


def test_warc_foreign_files(tmp_path):
    import gzip

    recs = [warc.record("response", f"<urn:record:{i}>", "u", "D", bytes([65 + i]) * (10 + i * 100_000), 1, None) for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    for name in ("a.warc", "b.warc.gz"):
        got = list(warc.records(f"file://{tmp_path}/{name}"))
        assert [len(b) for _, b in got] == [10, 100_010, 200_010]
        assert len(list(warc.records(f"file://{tmp_path}/{name}", lambda h: h["warc-record-id"] == "<urn:record:1>", False))) == 1
