"""Known values of operators that no SQL can say, and what must hold whatever the data."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sievemark.functions import answers as A
from sievemark.functions import chunking, text
from sievemark.functions.markup import spans, with_windows
from sievemark.functions.calculator import calculate, calculated
from sievemark.operators import audit, conversation, evaluate, filters, fusion, ledger, lexical, relational, vector
from sievemark.streaming import events


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_vectors(spark):
    v = lambda a: F.array(*[F.lit(x) for x in a])
    assert one(spark, vector.euclidean(v([1.0, 2.0]), v([4.0, 6.0]))) == 5.0
    assert one(spark, vector.euclidean(v([1.0, 2.0]), v([1.0, 2.0]))) == 0.0
    with pytest.raises(Exception, match="one length"):
        one(spark, vector.euclidean(v([1.0]), v([4.0, 6.0])))
    assert one(spark, vector.cosine(v([1.0, 0.0]), v([0.0, 0.0]))) is None


def test_knn_and_ivf(spark):
    vec = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    ask = vec.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r.qid, r.vec_id) for r in vector.knn(vec, ask, 10).collect()}
    near = {(r.qid, r.vec_id) for r in vector.ivf_knn(vec, ask, 10, probes=12).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    shuffled = vector.knn(vec.repartition(7), ask, 10)
    assert {(r.qid, r.vec_id) for r in shuffled.collect()} == exact
    assert vector.knn(vec, ask.limit(0), 10).count() == 0
    odd = vec.limit(1).select(F.lit(9999).cast("long").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"), "label")
    assert {(r.qid, r.vec_id) for r in vector.knn(vec.unionByName(odd), ask, 10).collect()} == exact


def test_text(spark):
    assert one(spark, text.or_query(F.lit("Apple 2024 revenue / net sales?"))) == "apple | 2024 | revenue | net | sales"
    assert {"bert-base", "87.4%", "f1", "squad", "2.0"} <= set(one(spark, text.paper_tokens(F.lit("BERT-base reached 87.4% F1 on SQuAD 2.0"))))
    assert str(one(spark, text.decimal_value(F.lit("$ 49. 63")))) == "49.630000"
    assert str(one(spark, text.decimal_value(F.lit("(1,234)")))) == "-1234.000000"
    assert one(spark, text.decimal_value(F.lit("none"))) is None
    assert one(spark, text.named_entities(F.lit("the age of Guillermo Bichara in the report"))) == ["Guillermo Bichara"]
    assert one(spark, text.fiscal_years(F.lit("FY2024 and 120235 and 2022, 2024"))) == [2024, 2022]
    assert one(spark, text.item_reference(F.lit("see item 7a."))) == "Item 7A"
    assert one(spark, text.search_tokens(F.lit("The 1,234.5% of A&B. (net)"))) == ["1234.5%", "a&b", "net"]
    assert one(spark, text.scale_name(F.lit("(in Thousands)"))) == "thousand"
    assert one(spark, text.char_token_estimate(F.lit("中文abcd"))) == 3
    assert one(spark, text.clean_lines(F.lit(" a \r\n\n\n\n b  c "))) == "a\n\nb c"


def test_calculator(spark):
    assert calculate("(12.5+7.5)*3-2^3") == "52" and calculate("2^-3") == "0.125" and calculate("1/3") == "0." + "3" * 34
    assert calculate("12345678901234567890*98765432109876543210") == str(12345678901234567890 * 98765432109876543210)
    assert [calculate(x) for x in (None, "", "1/0", "2+", "(1", "x", "2^99999999")] == [None] * 7
    assert calculate("-2^2") == "-4" and calculate("2^3^2") == "512" and calculate("7%4") == "3"
    df = spark.createDataFrame([("1+1",), (None,)], "e string")
    assert [r.v for r in df.select(calculated("e").alias("v")).collect()] == ["2", None]


def test_ledger(spark):
    d = lambda x: F.lit(x).cast("decimal(20,6)")
    value = lambda c: float(one(spark, c))
    assert value(ledger.percent_change(d("100"), d("120"))) == 20 and value(ledger.percent_change(d("8903"), d("41350"))) == pytest.approx(364.45, abs=0.01)
    assert value(ledger.difference(d("4972"), d("2354"))) == 2618 and round(value(ledger.ratio(d("391035"), d("60922"))), 4) == 6.4186
    assert value(ledger.margin(d("14.33"), d("100"))) == pytest.approx(14.33)
    assert one(spark, ledger.ratio(d("1"), d("0"))) is None and one(spark, ledger.percent_change(d("0"), d("5"))) is None
    assert value(ledger.cagr(d("100"), d("121"), F.lit(2))) == pytest.approx(10) and one(spark, ledger.cagr(d("0"), d("1"), F.lit(2))) is None
    assert one(spark, ledger.shaped(d("364.4501"), 1)) == "364.5" and one(spark, ledger.shaped(d("5132"), 4)) == "5132" and one(spark, ledger.shaped(d("2354000"), 3, 1_000_000)) == "2.354"
    assert one(spark, ledger.operator_name(F.lit(" subtract "))) == "DIFFERENCE"


def test_merge_and_bind(spark):
    cols = "company string, year int, value decimal(20,6)"
    from decimal import Decimal as D

    a, b = spark.createDataFrame([("A", 1, D(1))], cols), spark.createDataFrame([("A", 1, D(9)), ("A", 2, D(3)), ("A", 2, D(3))], cols)
    assert sorted((r.year, int(r.value), r.fact_id) for r in ledger.merge_facts(a, b, ["company", "year"]).collect()) == [(1, 1, "F1"), (2, 3, "F2")]
    facts = spark.createDataFrame([("A", 1, D(1), False), ("A", 1, D(2), False), ("B", 1, D(5), False), ("B", 1, D(7), True)], cols + ", aggregate boolean")
    ask = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1)], "company string, year int")
    assert {r.company: r.value and int(r.value) for r in ledger.bind(ask, facts, ["company", "year"]).collect()} == {"A": None, "B": 7, "C": None}


def test_numeric_scores(spark):
    agree = lambda e, p, pct=False: one(spark, A.numbers_agree(F.lit(e), F.lit(p), F.lit(pct)))
    assert agree(2.0, 2.022, True) and agree(2.4, 2354.0) and not agree(2.4, 2.0)
    scores = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(A.numeric_scores(A.answer_numbers(F.col("a")), A.answer_numbers(F.col("b"))).alias("s")).first().s
    row = scores("growth of 2% and 5 units", "2.022% growth")
    assert (row.precision, row.recall, round(row.f1, 4)) == (1.0, 0.5, 0.6667)
    assert scores("no number", "5") is None


def test_rouge_and_overlap(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "c", "d"]), (2, [], []), (3, ["a"], [])], "id int, e array<string>, p array<string>")
    assert [round(r.r, 4) for r in df.select("id", evaluate.rouge_l("e", "p").alias("r")).orderBy("id").collect()] == [0.6667, 1.0, 0.0]
    assert [r.f1 for r in evaluate.token_overlap(df, "e", "p", "id").orderBy("id").collect()] == [0.666667, 1.0, 0.0]


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, r, int(r > 1)) for r in range(1, 5)] + [(2, 1, 0)], "qid int, rank int, rel int")
    gold = spark.createDataFrame([(1, 3), (2, 0)], "qid int, gold int")
    got = {(r.qid, r.k): r for r in evaluate.ranking_metrics(ranked, gold).collect()}
    assert (got[1, 3].recall, got[1, 3].mrr, got[1, 3].map) == (0.666667, 0.5, round((1 / 2 + 2 / 3) / 3, 6))
    assert got[2, 1].ndcg is None and got[1, 1].recall <= got[1, 3].recall <= got[1, 5].recall


def test_percentiles(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,)], "v double")
    r = df.agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).first()
    assert (r.a, round(r.b, 6)) == (25.0, 38.5)


def test_report(spark):
    df = spark.createDataFrame([("S1", 1.0, False), ("S1", 0.0, True)], "subset string, v double, issue boolean")
    top = [r for r in evaluate.report(df, "subset", ["v"], "issue").collect() if r.overall == 1][0]
    assert (top.n, top.v_mean, top.v_clean) == (2, 0.5, 1.0)


def test_budget_and_balance(spark):
    df = spark.createDataFrame([(1,), (2,), (20,)], "n int")
    a, b = fusion.budget(F.col("n"), 24)
    assert [(r.a, r.b) for r in df.select(a.alias("a"), b.alias("b"), "n").orderBy("n").collect()] == [(3, 12), (4, 16), (24, 48)]


def test_rrf_is_symmetric_and_near_duplicates(spark):
    v = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "qid int, doc_id int, rank int, score double")
    b = spark.createDataFrame([(1, 11, 1, 3.0), (1, 12, 2, 2.0)], "qid int, doc_id int, bm25_rank int, bm25_score double")
    got = {r.doc_id: r.rrf for r in fusion.rrf(v, b).collect()}
    other = fusion.rrf(b.toDF("qid", "doc_id", "rank", "score"), v.toDF("qid", "doc_id", "bm25_rank", "bm25_score"))
    assert {r.doc_id: r.rrf for r in other.collect()} == got and got[11] == round(1 / 62 + 1 / 61, 9)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, "s", words), (2, "s", words + ["x"]), (3, "s", words[::-1]), (4, "s", words), (5, "t", words)], "doc_id int, source string, tokens array<string>")
    assert sorted((r.a, r.b) for r in fusion.near_duplicates(docs).collect()) == [(1, 2), (1, 4)]


def test_dominant_and_relaxed(spark):
    c = spark.createDataFrame([(1, "A", 4), (1, "B", 2), (2, "A", 3), (2, "B", 2), (3, "A", 1)], "qid int, name string, n int")
    assert [(r.qid, r.name) for r in lexical.dominant(c, "name").collect()] == [(1, "A")]
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2)], "k string, v int")
    assert sorted(tuple(r) for r in filters.relaxed(df, "k", [F.col("v") == 1, F.lit(True)]).collect()) == [("x", 1, 0), ("y", 2, 1)]


def test_contains_join(spark):
    d = spark.createDataFrame([(1, "a bb ccc dd"), (2, "zbb ccc d"), (3, ""), (4, None)], "id int, t string")
    i = spark.createDataFrame([(1, "bb ccc d"), (2, "cc"), (3, ""), (4, "bb ccc d")], "item int, p string")
    assert sorted((r.id, r.item) for r in relational.contains_join(d, i, "id", "t", "item", "p").collect()) == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (2, 4)]


def test_citations(spark):
    ev = spark.createDataFrame([(1, "E1", "ACME", 2023, "of 2021"), (1, "E2", "BETA", 2024, ""), (3, "E1", "ACME", 2023, ""), (4, "E1", "ACME", 2023, ""), (5, "e1", "ACME", 2023, "")], "qid int, ref string, company string, year int, content string")
    calc = spark.createDataFrame([(4, "C1"), (5, "C1")], "qid int, ref string")
    ans = spark.createDataFrame([(1, "ACME sold 5 in 2021 [E1].\nRevenue was 7 million.\nSee [E9].\nBETA in 2024 [E1]."), (2, "  "), (3, "No marks here"), (4, "It is calculated as (5 - 3) [E1]\n2. In FY2023, Item 7 and 10-K"), (5, "Up 12% [C1; E1]\nSources: 3 files"), (6, None)], "qid int, answer string")
    got = {(r.qid, r.code) for r in audit.citation_issues(ans, ev, calc).collect()}
    assert got == {(1, "uncited_numeric_claim"), (1, "unknown_reference"), (1, "company_mismatch"), (1, "year_mismatch"), (2, "empty_answer"), (3, "missing_evidence"), (4, "missing_calculation"), (4, "unverified_calculation"), (6, "empty_answer")}
    facts = spark.createDataFrame([(1, "F1", "E1", 2024)], "qid int, ref string, evidence string, year int")
    assert (1, "year_mismatch") not in {(r.qid, r.code) for r in audit.citation_issues(ans, ev, calc, facts).collect()}


def test_conversation(spark):
    m = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(["user", "assistant", "user", "assistant"])] + [(2, 0, "system", "s")], "conv_id int, turn int, role string, text string")
    assert sorted((r.conv_id, r.turn) for r in conversation.rewind(m).collect()) == [(1, 0), (1, 1), (2, 0)]
    assert {r.conv_id: r.context for r in conversation.recent_context(m, 2).collect()} == {1: "user: t2\nassistant: t3", 2: "system: s"}
    assert one(spark, conversation.add_usage(F.lit(None).cast("int"), F.lit(3))) == 3
    assert [one(spark, conversation.round_limit(F.lit(n))) for n in (1, 65, 200, 999)] == [64, 96, 216, 256]


HTML = """<html><head><title>T</title><script>var x = '<p>no</p>';</script></head><body><div hidden>gone <b>too</b></div>
<h1>Item 7. Management Discussion</h1><p>Net&nbsp;sales &amp; costs.</p><table><tr><th>Label</th><th>Year ended December 31, 2024</th></tr>
<tr><td>Sales | net</td><td>1,234</td></tr><tr><td></td></tr><tr><td>Cost</td></tr></table><h2>Item 8. Financial Statements</h2><p>End.</p></body></html>"""


def test_html(spark):
    at, end = HTML.index("<table"), HTML.index("</table>")
    df = spark.createDataFrame([(HTML,), (None,)], "h string")
    read = df.select(chunking.page(F.col("h")).alias("p")).select(chunking.many_lines(F.col("p.text")).alias("text"), chunking.matrices(F.col("p.tables")).alias("tables"))
    (body, tables), empty = read.collect()
    assert tuple(empty) == ("", [])
    assert "gone" not in body and "too" not in body and "var x" not in body and "Net sales & costs." in body
    assert tables == [[["Label", "Year ended December 31, 2024"], ["Sales | net", "1,234"], ["Cost", ""]]]
    rows = lambda t: F.from_json(F.lit(json.dumps(t)), "array<array<string>>")
    assert one(spark, chunking.header_rows(rows(tables[0]))) == 3 and one(spark, chunking.header_rows(rows([["a", "b"], ["1", "2"], ["3", "4"]]))) == 1
    assert "Sales / net" in one(spark, chunking.markdown(rows(tables[0]))) and one(spark, chunking.markdown(rows([]))) == "" and one(spark, chunking.table_chunks(rows([]))) == []
    place = lambda a, b: chunking.around(F.lit(HTML), F.lit(a), F.lit(b))
    item = lambda a: tuple(one(spark, chunking.last_item(place(a, a)[0])))
    assert item(at) == ("Item 7", "Management Discussion") and item(10) == ("", "")
    assert tuple(one(spark, chunking.table_context(place(at, end), 3))) == ("& costs .", "Item 8 .")
    whole = df.select(chunking.interleaved(F.col("h")).alias("x")).collect()
    assert "Markdown table:\n| Label | Year ended December 31, 2024 |" in whole[0].x and whole[0].x.count("Markdown table:") == 1 and whole[1].x == ""
    sections = lambda t: [tuple(s) for s in one(spark, chunking.sections(F.lit(t)))]
    assert [s[:2] for s in sections(body) if s[0]] == [("Item 7", "Management Discussion"), ("Item 8", "Financial Statements")]
    assert sections(" no heading ") == [("", "", " no heading ")] and sections("") == []
    # a heading's title takes what looks like a heading within its 120 characters
    assert sections("Item 7. See Item 8. Statements\nx\nitem 1a - Risk Factors") == [("Item 7", "See Item 8. Statements", "Item 7. See Item 8. Statements\nx"), ("Item 1A", "Risk Factors", "item 1a - Risk Factors")]
    assert tuple(one(spark, chunking.periods(F.lit("As of March 1, 2023 and FY 2024; fy 2024")))) == (["As of March 1, 2023", "FY 2024"], ["2023", "2024"], "As of March 1, 2023")
    assert tuple(one(spark, chunking.periods(F.lit("in 2020 or 2021")))) == (["2020", "2021"], ["2020", "2021"], "2020") and tuple(one(spark, chunking.periods(F.lit("")))) == ([], [], "")


def test_long_sections(spark):
    part = "words. " * 30_000
    df = spark.createDataFrame([(f"{part}\nItem 7. Results of All\n{part}\nItem 8. Statements\n{part}",)], "t string")
    got = df.select(F.explode(chunking.sections(F.col("t"))).alias("s")).collect()
    assert [len(r.s.content) for r in got] == [len(part) - 1, len(part) + 23 - 1, len(part) + 19 - 1]


def test_table_chunks(spark):
    rows = [["Label", "2024"]] + [[f"row {i}", str(i)] for i in range(40)]
    made = lambda **k: one(spark, chunking.table_chunks(F.from_json(F.lit(json.dumps(rows)), "array<array<string>>"), **k))
    parts = made(most=300)
    assert len(parts) > 2 and all("| Label | 2024 |" in p and len(p) <= 320 for p in parts)
    assert all(any(f"row {i} " in p for p in parts) for i in range(40))
    last = [p.rpartition("\n")[2] for p in parts]
    assert all(q.split("\n")[2] == x or x in q for x, q in zip(last, parts[1:]))
    apart = "\n".join(made(most=300, least=1, overlap=False))
    assert all(apart.count(f"| row {i} |") == 1 for i in range(40) if i > 3)


def plain_parent(children, at, most):
    lo, hi, total = at, at, len(children[at])
    for step in range(1, len(children)):
        took = False
        for i in (at - step, at + step):
            if 0 <= i < len(children) and total + len(children[i]) + 2 <= most:
                total, lo, hi, took = total + len(children[i]) + 2, min(lo, i), max(hi, i), True
        if not took:
            break
    return "\n\n".join(children[lo : hi + 1]).strip()[:most].rstrip()


def test_parents_against_plain_ones(spark):
    rng = random.Random(7)
    cases = [([rng.choice("abc") * rng.randint(1, 30) for _ in range(rng.randint(0, 14))], most) for most in (1, 12, 40, 100) for _ in range(25)]
    for most in (1, 12, 40, 100):
        own = [c for c, m in cases if m == most]
        df = spark.createDataFrame(list(enumerate(own)), "i int, c array<string>")
        for r in df.select("i", chunking.parent_windows(F.col("c"), most).alias("p")).collect():
            assert r.p == [plain_parent(own[r.i], k, most) for k in range(len(own[r.i]))]


def plain_pieces(text, most):
    at = [m.start() for m in re.finditer(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?|[^\w\s]", text)]
    edges = [0, *at[most::most], len(text)]
    return [p for p in (text[a:b].strip() for a, b in zip(edges, edges[1:])) if p]


def test_tokens_against_plain_ones(spark):
    rng = random.Random(11)
    texts = ["", None, "é" * 30_000, "one two, three  four"] + ["".join(rng.choice(["ab", "é", "_", " ", "\n", "-", "'", ".", "7", "\u00a0", "中"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for most in (1, 2, 7):
        for r in df.select("i", chunking.token_pieces(F.col("t"), most).alias("p"), chunking.trim_to_tokens(F.col("t"), most).alias("x")).collect():
            text = texts[r.i]
            assert r.p == plain_pieces(text or "", most)
            if text is None:
                assert r.x is None
                continue
            ends = [m.end() for m in re.finditer(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?|[^\w\s]", text[: 3 * most])]
            assert r.x == (text[: 3 * most].rstrip() if len(ends) <= most else text[: ends[most - 1]])


def test_windows(spark):
    t = " ".join(f"word{i}." for i in range(500))
    df = spark.createDataFrame([([t, "", None, "x" * 1000],), (None,)], "t array<string>")
    parts, none = (r.windows for r in with_windows(df, "t", 300, 50).collect())
    assert none is None and parts[1:3] == [[], []] and len(parts[3]) == 4
    assert all(len(p) <= 300 for p in parts[0]) and parts[0][0].endswith(".") and t.endswith(parts[0][-1])


def plain_windows(text, size, overlap, marks):
    """Windows by trying every end."""
    out, begin = [], 0
    while begin < len(text):
        end = min(len(text), begin + size)
        if end < len(text):
            ends = [i + 1 for i in range(begin + size // 2 + 1, end) for m in marks if text[i : i + len(m)] == m and i + len(m) <= end]
            end = max(ends, default=end)
        out.append((begin, end))
        if end == len(text):
            break
        begin = max(begin + 1, end - overlap)
    return out


def test_windows_against_every_end():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", ". ", "\n", ".", "  "]) for _ in range(rng.randint(0, 120)))
        size, overlap = rng.randint(2, 40), rng.randint(0, 20)
        for marks in (("\n", ". ", " "), (". ", "\n")):
            assert spans(text, size, overlap, marks) == plain_windows(text, size, overlap, marks)


def test_paper_children_lie_in_their_parents(spark):
    text = "First section. " * 500 + "\n\n" + "Second one here. " * 300
    df = spark.createDataFrame([(9007199254740993, text, "x"), (None, "short", "x"), (3, None, "x")], "doc_id long, text string, content string")
    rows = chunking.paper_chunks(df).collect()
    assert {r.doc_id for r in rows} == {9007199254740993, None} and all(r.content in r.parent and len(r.parent) <= 6000 for r in rows)
    mine = sorted((r for r in rows if r.doc_id), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in mine] == list(range(len(mine))) and {r.section_index for r in mine} == {0, 1}
    assert {r.parent for r in mine if r.section_index == 1} == {("Second one here. " * 300).strip()}


def test_html_chunks(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, HTML + "<p>" + "word " * 900 + "</p>", "x"), (None, None, "x"), (3, "", "x")], "page_id long, html string, content string")
    got = chunking.html_chunks(df).collect()
    assert {r.page_id for r in got} == {big} and all(r.content in r.parent_context for r in got)
    assert [r.chunk_index for r in sorted(got, key=lambda r: r.chunk_index)] == list(range(len(got)))


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    batch = {(r.start, r.event_type, r.n) for r in events.windowed(spark.read.parquet(f"{src}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    q = events.windowed(events.stream(spark, src)).writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
        assert {(r.start, r.event_type, r.n) for r in spark.sql("select * from windowed").collect()} == batch
    finally:
        q.stop()




def test_window_at_line_end(spark):
    """A line end right before the window's start is no part of a word, so the word before it isn't taken in."""
    t = "a" * 30 + "\n" + "b" * 12 + " anchored " + "y " * 30
    assert one(spark, text.centred_window(F.lit(t), F.lit("anchored"), 40)) == "... " + "b" * 12 + " anchored y y y y y ..."
