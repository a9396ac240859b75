"""Each stage against brute force on its own input, and all of them in a row."""

import re

import corpus_pipeline as cp
import public_tokenizers as P
import pytest

from sievemark.llm import quality
from test_ngram_rules import brute
from test_text_ops import brute_hits, brute_secrets, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage got and returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF)
        assert name == "token_ids" or got.columns == docs.columns
        path = str(tmp_path_factory.mktemp("stage") / name)
        got.write.parquet(path)
        new = spark.read.parquet(path)
        out.append((docs.collect(), new.collect()))
        docs = new
    return out


def test_quality(spark, kept):
    old, new = kept[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = quality.Scorer(quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    good = {r.doc_id for r in old if scorer.scores([r.text.encode()])[0] >= 0.7}
    assert {r.doc_id for r in new} == good and 0 < len(good) < len(old)


def test_groups(kept):
    old, new = kept[1]
    want = {k for k, c in brute([(r.doc_id, r.text) for r in old], 5, 80, 100) if k == c}
    assert sorted(r.doc_id for r in new) == sorted(want)


def test_benchmark(spark, kept):
    old, new = kept[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in new} == {r.doc_id for r in old if not brute_hits(r.text, items)[3]}


def test_secrets(kept):
    old, new = kept[3]
    text = {r.doc_id: r.text for r in new}
    assert len(old) == len(new)
    for r in old:
        spans = brute_secrets(r.text)
        if not spans:
            assert text[r.doc_id] == r.text or "[SECRET]" in text[r.doc_id]
        for s, k, e in spans:
            value = re.search(r"[:=]\x20*[\"']?(.*)", r.text[s:e]).group(1) if k == 0 else r.text[s:e]
            assert value not in text[r.doc_id]
        assert not [x for x in brute_secrets(text[r.doc_id]) if x[1] > 0]


def test_token_ids(kept):
    old, new = kept[4]
    enc = plain()
    assert {r.doc_id: r.token_ids for r in new} == {r.doc_id: enc.encode_ordinary(r.text) for r in old}
    assert all(r.n_tokens == len(r.token_ids) for r in new)


def test_run(spark, kept):
    assert sorted(r.doc_id for r in cp.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in kept[4][1])


def test_odd_rows(spark, tmp_path):
    long = "word after word of one very long text " * 40_000
    rows = [(None, "good words in a row here", None, None, None), (None, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "password=abcdefgh1", "en", "a", 18), (2, "password=abcdefgh1", "en", "a", 18), (3, "one text of a key", "en", "a", 17), (3, "and a wholly different text that has it too", "en", "b", 43), (4, long, "en", "a", len(long)), (4, "One text of a key", "de", "a", 17)]
    clash = "score double, predicted string, items string, spans string, n_words int, n_hit int, n_items int, contaminated string, `all` string, more string, name string, found string, n int"
    kept = tuple([-5.0, *["mine"] * 3, 7, 7, 7, *["mine"] * 5, 7])
    spark.createDataFrame([(*r, *kept) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for _, stage in cp.STAGES[1:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    have = docs.collect()
    assert all(tuple(r)[5:] == kept for r in have)
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in have) == sorted([(0, "", 0), (0, "good words in a row here", 0), (1, "", 0), (2, "password=[SECRET]", 17), (3, "one text of a key", 17), (3, "and a wholly different text that has it too", 43), (4, long, len(long))])
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_labels_by_key(spark, tmp_path):
    """Columns of documents come back from the first stage as they were."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'own' AS score", "doc_id AS predicted")
    got = cp.quality_filter(spark, docs, SF)
    assert got.columns == docs.columns and {(r.score, r.predicted - r.doc_id) for r in got.collect()} == {("own", 0)}
