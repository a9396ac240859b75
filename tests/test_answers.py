"""Numbers, scores and calculations of answers by plain loops over the same questions, and texts that are easily misread."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievemark.functions import answers as A
from sievemark.functions import text as X
from sievemark.jobs import cases, registry
from sievemark.operators import evidence as E
from sievemark.operators import lexical

SF = "/root/testdata/sf0.001"
WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
MONTHS = "January February March April May June July August September October November December".split()


def numbers(text):
    """Numbers of an answer: years are counted in words, identifiers and references skipped piece by piece."""
    kept = []
    for line in (text or "").replace("&amp;", "&").split("\n"):
        if re.match(r"(?i)(sources?|来源)", line.lstrip(" \t#>*_`-")):
            break
        kept.append(line)
    t = re.sub(r"(?i)\[[EFC]\d+(\s*[;,]\s*[EFC]?\d+)*\]", " ", "\n".join(kept))
    t = " ".join(re.sub(r"[`*_>#|]", " ", re.sub(r"(?i)\b[EFC]\d+\b", " ", t)).split())
    out = [(float(WORDS.index(w.lower()) + 1), False) for w in re.findall(rf"(?i)\b({'|'.join(WORDS)})\s+(?:fiscal\s+)?years?\b", t)]
    t = re.sub(rf"(?i)\b({'|'.join(MONTHS)})\s+\d{{1,2}},\s+20\d\d\b", "", t)
    t = re.sub(r"(?i)\b(FY\s*)?20\d\d\b|\b(Item|Part|Section|Note)\s+\d+[A-Z]?(\.\d+)?\b|\b10-[KQ]\b", "", t)
    out += [(float(x.strip("%").replace(",", "")), x.endswith("%")) for x in re.findall(r"[-+]?\d[\d,]*(?:\.\d+)?%?", t)]
    return list(dict.fromkeys(out))


def agree(e, p, percent):
    near = max(0.15 if percent else 0.05, abs(e) / 1000)
    shifted = [(p / 1000, near)] if abs(p) >= 1000 and abs(e) < 100 else [(p * 1000, max(50.0, abs(e) / 1000))] if abs(e) >= 1000 and abs(p) < 100 else []
    return any(abs(e - x) <= n for x, n in [(p, near), *([] if percent else shifted)])


def scores(expected, stated):
    if not expected:
        return None
    left = list(stated)
    for e, pct in expected:
        hit = next((i for i, (p, q) in enumerate(left) if p is not None and q == pct and agree(e, p, pct)), None)
        if hit is not None:
            left[hit] = (None, None)
    n = sum(p is None for p, _ in left)
    p, r = n / len(stated) if stated else 0.0, n / len(expected)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


@pytest.fixture(scope="module")
def asked(spark):
    return {r.qid: r for r in cases.questions(spark, SF).collect()}


def near(a, b):
    return a is None and b is None or abs(a - b) < 2e-6


def test_numeric_scores(spark, asked):
    got = registry.QUERIES["ev04_numeric_scores"](spark, SF).collect()
    assert len(got) == len(asked)
    for r in got:
        want = scores(numbers(asked[r.qid].expected), numbers(asked[r.qid].predicted)) or (None,) * 3
        assert all(near(a, b) for a, b in zip((r.precision, r.recall, r.f1), want)), (r, want)


def test_fact_value_recall(spark, asked):
    values = defaultdict(set)
    for r in cases.evidence(spark, SF).where("fault < 4").collect():
        values[r.qid].add(float(r.amount))
        if r.scale in ("million", "billion"):
            values[r.qid].add(float(r.amount) / 1000 if r.scale == "million" else float(r.amount) * 1000)
    for r in registry.QUERIES["ev05_fact_value_recall"](spark, SF).collect():
        want = scores(numbers(asked[r.qid].expected), [(v, False) for v in sorted(values[r.qid])])[1] if r.qid in values else None
        assert near(r.recall, want), (r, want)


def test_calculation_match(spark, asked):
    got = registry.QUERIES["ev06_calculation_match"](spark, SF).collect()
    assert {r.matched for r in got} == {True, False}
    for r in got:
        q = asked[r.qid]
        gold = numbers(f"{q.question} {q.expected} Before it was {q.pct} million.")
        price, pct = float(q.price), float(q.pct)
        value = round({"difference": price - pct, "percentage_change": pct + 0.5, "sum": price * 2}[r.kind], 2)
        own = r.kind == "percentage_change"
        hit = any(p == own and agree(g, value, p) for g, p in gold)
        pairs = [(a, b) for a, pa in gold for b, pb in gold if not pa and not pb and a != b]
        if r.kind == "difference":
            hit |= any(agree(abs(b - a), abs(value), False) for a, b in pairs)
        if own:
            hit |= any(a and agree((b - a) / a * 100, value, True) for a, b in pairs)
        assert r.matched == hit, r


def test_bodies(spark):
    said = ["A &lt;b&gt;\n**Sources:** x", None, "Source of income is E1, [e2, 3; F4] and `C5`|", "#  来源\nx", "E12a stays, AE1 too"]
    got = [r.b for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(A.answer_body(F.col("t")).alias("b")).collect()]
    assert got == ["A <b", "", "", "", "E12a stays, AE1 too"] or got == ["A <b", "", "", "", "E12a stays, AE1 too"]


def test_direct_values(spark):
    def one(metric, content):
        return spark.createDataFrame([(metric, content)], "m string, c string").select(A.direct_value(F.col("m"), F.col("c")).alias("x")).first().x

    assert one("revenue", "| Total net sales (1) | 5 |") and not one("revenue", "| Costs | 5 |\nNet sales were 5.")
    assert one("net income", "Net earnings rose to $5.") and not one("net income", "Net earnings rose in 2023. See Item 7.")
    assert not one("net income", "Net earnings rose. It has 5 plants.") and not one("", "Net 5") and one("Gross margin", "The gross margin is 7%.")


def test_windows_of_evidence(spark):
    text = "aaaa " * 100 + "important words here " + "bbbb " * 100
    w = spark.createDataFrame([(text,)], "t string").select(X.centred_window(F.col("t"), F.lit("Important?"), 120).alias("w"), X.centred_window(F.lit("short"), F.lit("x"), 120).alias("s"), X.centred_window(F.col("t"), F.lit(""), 120).alias("n")).first()
    assert "important words here" in w.w and len(w.w) <= 128 and w.w.startswith("... ") and w.w.endswith(" ...")
    assert w.s == "short" and w.n.startswith("aaaa") and not w.n.startswith("...")


def test_entities_in_ranking(spark):
    docs = spark.createDataFrame([(1, "They saw the great lakes and more", "h", False), (2, "great things", "h great", True), (3, None, "h", False)], "doc_id int, text string, header string, is_table boolean")
    asked = spark.createDataFrame([(7, "about Great Lakes in Net Sales", ["great", "lakes"])], "qid int, text string, terms array<string>")
    scored = spark.createDataFrame([(7, 1, 1.0), (7, 2, 1.0), (7, 3, 1.0)], "qid int, doc_id int, score double")
    boosts = lexical.Boosts(docs, asked)
    assert {r.doc_id: round(r.boost, 6) for r in boosts.of(scored).collect()} == {1: 1.5, 2: 0.52, 3: 0.0}
    assert sorted(tuple(r) for r in boosts.alone(9).collect()) == [(7, 1), (7, 2)]


def test_rows_that_a_boost_brings_in(spark):
    """Kinds of documents, of which only the first k by key matter, against a plain ranking of all."""
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["net income", "revenue", "rare", "x", "Blue Whale"]) for _ in range(3)), r.choice(["h rare", "h", "x h", None]), r.random() < 0.3) for i in range(300)]
    asked = [(1, "net income of revenue", ["rare", "zzz"]), (2, "Blue Whale", ["h", "h"]), (3, "nothing", ["zzz"])]
    d, q = spark.createDataFrame(docs, "doc_id int, text string, header string, is_table boolean"), spark.createDataFrame(asked, "qid int, text string, terms array<string>")
    boosts = lexical.Boosts(d, q)
    scored = {k: {(x.qid, x.doc_id): x.score for x in lexical.bm25(d, q, also=boosts.alone(k)).collect()} for k in (5, 300)}
    plain = {(x.qid, x.doc_id): x.score for x in lexical.bm25(d, q).collect()}

    def boost(i, q):
        _, text, header, table = docs[i]
        _, asking, terms = asked[q - 1]
        low, head = text.lower(), (header or "").lower()
        entity = "blue whale" in low and "Blue Whale" in asking
        return min(3.0, 0.4 * table + 0.12 * sum(t in head for t in terms) + 0.18 * sum(p in asking.lower() and p in low for p in lexical.SERVICE_PHRASES) + 1.5 * entity)

    for k in scored:
        want = sorted((q, -round(plain.get((q, i), 0) + boost(i, q), 6), i) for q in (1, 2, 3) for i in range(300) if plain.get((q, i), 0) + boost(i, q) > 0)
        want = [x for j, x in enumerate(want) if sum(y[0] == x[0] for y in want[:j]) < k]
        rows = spark.createDataFrame([(*p, float(s)) for p, s in scored[k].items()], "qid int, doc_id int, score double")
        got = sorted((x.qid, -x.bm25_score, x.doc_id) for x in lexical.rank_boosted(boosts.of(rows), k).collect())
        assert got == want and any(x[2] not in {i for q, i in plain if q == x[0]} for x in want)


def test_entities(spark):
    """Phrases of capitalised words, against Python's own patterns on every document."""
    phrase = re.compile(r"(?<!\w)([A-Z][a-z]{2,}(?:[ \t\n\x0b\f\r]+[A-Z][a-z]{2,}){1,3})(?!\w)")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.entities for r in registry.QUERIES["tx12_entities"](spark, SF).collect()}
    assert got == {k: "; ".join(dict.fromkeys(phrase.findall(t))) for k, t in docs}
    made = spark.createDataFrame([("The Big Apple Inc And More Words Here. Ödön Big Apple_ New York, New York",)], "t string")
    assert made.select(X.named_entities(F.col("t")).alias("e")).first().e == phrase.findall("The Big Apple Inc And More Words Here. Ödön Big Apple_ New York")


def test_intents_and_scales(spark):
    said = ["Compare a and b", "What is the margin?", "Which risks?", "By segment", "How many?", None]
    assert [r.i for r in spark.createDataFrame(list(enumerate(said)), "n int, t string").orderBy("n").select(X.intent(F.col("t")).alias("i")).collect()] == ["comparison", "calculation", "risk_factor", "segment_breakdown", "factual_metric", "factual_metric"]


def test_token_split(spark):
    """Parents and children hold all tokens in order, at most so many each."""
    token = re.compile(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?|[^\w\s]")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sorted(registry.QUERIES["ch13_token_split"](spark, SF).collect(), key=lambda r: (r.doc_id, r.parent_index, r.child_index))
    whole = defaultdict(list)
    for r in rows:
        own = token.findall(r.content)
        assert len(own) <= 64
        whole[r.doc_id] += own
    assert all(whole[k] == token.findall(t) for k, t in text.items())


def test_expected_documents_odd(spark):
    rows = [(1, "ACME grew in FY2021; BOLT fell in 2022", ["ACME", "BOLT"], ["2021", "2022"]), (2, "In 2021 it was BOLT, " + "x" * 90 + " ACME", ["ACME", "BOLT"], ["2021", "2022"]), (3, "nothing", ["ACME"], ["2021", "2022"]), (4, None, ["ACME", "BOLT"], ["2021", "2022"])]
    got = defaultdict(set)
    for r in E.expected_documents(spark.createDataFrame(rows, "qid int, text string, companies array<string>, years array<string>")).collect():
        got[r.qid].add(r.source_file[:-5])
    assert got[1] == {"ACME_2021", "BOLT_2022"} and got[2] == {"BOLT_2021"} and got[3] == {"ACME_2021", "ACME_2022"}
