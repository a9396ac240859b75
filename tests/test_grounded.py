"""Golden values of facts without a model, of the enforcement ladder, of direct answers and of the rule of scales."""

from pyspark.sql import functions as F

from sievemark.functions import answers as A
from sievemark.jobs import registry
from sievemark.operators import direct, enforcement, grounded

EV = "qid long, pos int, ref string, company string, fiscal_year string, content string"


def test_cash(spark):
    rows = [
        (1, 1, "E1", "META", "2024", "Table header: x | in thousands\n| Cash and cash equivalents | (1,043.50) | 41 |\n| Cash and cash equivalents | 7 |\n| Short-term investments | n/a |"),
        (1, 2, "E2", "META", "2023", "We had cash, cash equivalents and short-term investments that came to about $65.40 billion."),
        (2, 1, "E1", "META", "2024", "| Cash and cash equivalents | 5 |"),
    ]
    q = spark.createDataFrame([(1, "What is the Total  cash with short-term investments?"), (2, "What is total cash?")], "qid long, question string")
    got = grounded.deterministic_facts(q, spark.createDataFrame(rows, EV)).orderBy("fact_id").collect()
    assert [(r.fact_id, r.ref, r.metric, r.raw_value, float(r.value), r.scale) for r in got] == [
        ("F1", "E1", "Cash and cash equivalents", "$-1043.5 thousand", -1043.5, "thousand"),
        ("F2", "E2", "Total cash, cash equivalents, and short-term investments", "$65.4 billion", 65.4, "billion"),
    ]


def test_premise(spark):
    rows = [
        (1, 1, "E1", "AAA", "2024", "| Net income | 1,000 | 900 |\n| Net income attributable to noncontrolling interests | 1,040 | 1 |\n| Net earnings | 1,050 | 880 |"),
        (1, 2, "E2", "AAA", "2024", "Table header: in billions\n| Net income | 1.02 | 0.7 |\n| Net income | 1.045 |"),
        (2, 1, "E1", "AAA", "2024", "| Net income | 1,000 | 900 |"),
    ]
    q = spark.createDataFrame([(1, "Net income for fiscal year 2024 is $1,041 million; why?"), (2, "net income for fiscal 2024 is 1.2 billion"), (3, "net income for fiscal 2024 is 1.2 billion"), (4, None)], "qid long, question string")
    got = grounded.deterministic_facts(q, spark.createDataFrame(rows, EV)).orderBy("fact_id").collect()
    assert [(r.qid, r.fact_id, r.ref, r.metric, r.fiscal_year, r.raw_value) for r in got] == [(1, "F1", "E1", "Net earnings", "2024", "$1050 million"), (1, "F2", "E1", "Net earnings", "2023", "$880 million")]


def test_nearest_at_the_edges(spark):
    """Values on both sides of a power of two, exactly at the tolerance, beyond it, and in a tie."""
    wanted = spark.createDataFrame([(1, 1024.0), (2, 100.0), (3, 100.0), (4, 1.0)], "qid long, t double").withColumn("t", F.col("t").cast("decimal(20,4)"))
    rows = spark.createDataFrame([(1, 1, 1023.0), (1, 2, 1027.0), (2, 1, 108.0), (2, 2, 91.0), (3, 1, 95.0), (3, 2, 105.0), (4, 1, 1.09)], "qid long, place int, v double").withColumn("v", F.col("v").cast("decimal(20,4)"))
    assert {r.qid: r.place for r in grounded.nearest(rows, wanted, "v", "t").collect()} == {1: 1, 2: 1, 3: 1}


def test_plan_facts(spark):
    kind = "qid long, plan string, pos int, operator string, task string, company string, year string, metric string, raw_value string, scale string"
    docs = "qid long, pos int, ref string, company string, fiscal_year string, content string, tasks array<string>"
    ev = spark.createDataFrame([
        (1, 1, "E1", "AAA", "2023", "x" * 600 + " Revenue was $1,000 thousand in all. " + "y" * 600, ["t1"]),
        (1, 2, "E2", "AAA", "2024", "Table header: in millions\n| Total assets | 1,000 | 7 |\nNet sales were 7 units", ["t2"]),
    ], docs)
    o = [
        (1, "p", 1, "SUM", "t1", "aaa", "2023", "revenue", "1000", ""),  # found by its task, as another spelling
        (1, "p", 2, "SUM", "t1", "AAA", "2024", "total assets", "$1,000.0", ""),  # another task's, of its company and year
        (1, "p", 3, "SUM", "t1", "AAA", "", "total assets", "1000", ""),  # without a year another task's doesn't count
        (1, "p", 4, "SUM", "", "", "", "net sales", "7", "billions"),  # the first 7 stands in a row of another name
        (1, "p", 5, "COUNT", "", "", "", "revenue", "1000", ""), (1, "p", 6, "SUM", "", "", "", "revenue", "none", ""), (1, "p", 7, "SUM", "", "BBB", "", "revenue", "1000", ""),
    ]
    got = grounded.plan_facts(spark.createDataFrame(o, kind), ev).orderBy("fact_id").collect()
    assert [(r.fact_id, r.ref, r.company, r.fiscal_year, r.metric, float(r.value), r.scale) for r in got] == [("F1", "E1", "aaa", "2023", "revenue", 1000.0, "thousand"), ("F2", "E2", "AAA", "2024", "total assets", 1000.0, "million")]
    assert got[1].quote == "| Total assets | 1,000 | 7 |"
    # no line break is near, so 220 characters on each side of the number
    start = len("x" * 600 + " Revenue was $")
    assert got[0].quote == ev.first().content[start - 220 : start + 5 + 220].strip()


def test_scale_by_value(spark):
    case = [("$1,000", "", "sales", "| 5 | 1000 million", "", "million"), ("1000 million", "", "sales", "| Total | 1,000 |", "Table header: 2024 | (in thousands)", "thousand"), ("$2 million", "thousand", "sales", "Revenue was $2 million.", "", "million"), ("1.5", "Billions", "sales", "11.5 million", "", "billion"), ("49. 63", "unit", "arpp", "ARPP was $ 49. 63.", "", "unit")]
    df = spark.createDataFrame(case, "raw string, proposed string, metric string, quote string, content string, want string")
    for r in df.select("want", A.scale_of_fact(*[F.col(c) for c in ("raw", "proposed", "metric", "quote", "content")]).alias("got")).collect():
        assert r.got == r.want


def ladder(spark, answer, question="How much?", facts=True, calculations=(), strict=True, content="AAA had 5 in 2024"):
    answers = spark.createDataFrame([(1, answer, question)], "qid long, answer string, question string")
    evidence = spark.createDataFrame([(1, "E1", 1, "AAA", "2024", content, "AAA_2024.html", "Risk", "Item 8"), (1, "E2", 2, "BBB", "2023", "", "BBB_2023.html", "", "Item 7")], "qid long, ref string, pos int, company string, year string, content string, source_file string, section string, item string")
    rows = [(1, "F1", 1, "E1", "AAA", "2024", "Net income", "$5 million", 5000.0, "million"), (1, "F2", 2, "E2", "BBB", "2023", "Sales", "$2", 2.0, "unit")]
    f = spark.createDataFrame(rows if facts else [], "qid long, ref string, pos int, evidence string, company string, year string, metric string, raw_value string, value double, scale string")
    c = spark.createDataFrame(list(calculations), "qid long, ref string, pos int, type string, expression string, display string, scale string, unit string, fact_ids array<string>")
    return tuple(enforcement.enforced(answers, evidence, f, c, strict).first())[1:]


def test_ladder(spark):
    assert ladder(spark, "AAA had 5 in 2024 [E1]") == ("valid", "AAA had 5 in 2024 [E1]")
    # the line on another year goes, with the empty lines that it leaves
    assert ladder(spark, "AAA had 5 [E1]\n\nAAA in 2020 [E1]\n\n\nEnd") == ("salvaged", "AAA had 5 [E1]\n\nEnd")
    ratio = (1, "C1", 1, "multiple", "F1 / F2", "2.5", "unit", "times", ["F1", "f2"])
    assert ladder(spark, "It was 5 [E9]", "Of BBB and AAA?", calculations=[ratio]) == ("calculation", "BBB FY2023 sales was $2 [F2][E2]; AAA FY2024 net income was $5 million [F1][E1]. AAA's value was approximately 2.5 times larger than BBB's [C1][E1][E2].\n\nSources:\n[E1] AAA_2024.html\n[E2] BBB_2023.html")
    count = (1, "C1", 1, "count", "count(2024)", "1", "unit", "count", [])
    assert ladder(spark, "It was 5 [E9]", "What was net income in billion for fiscal 2024?", calculations=[count]) == ("question", "AAA fiscal 2024 net income was $5.0 billion [F1][E1]\nThe table covers 1 fiscal years (2024) [C1][E1]\n\nSources:\n[E1] AAA_2024.html")
    assert ladder(spark, "净利润是 5 E9", calculations=[count]) == ("ledger", "已核验事实：\n- AAA FY2024 | Net income = $5 million [F1][E1]\n- BBB FY2023 | Sales = $2 [F2][E2]\n\n确定性计算：\n- count: count(2024) = 1 unit count [C1][E1]\n\n来源：\n[E1] AAA_2024.html — Risk\n[E2] BBB_2023.html — Item 7")
    assert ladder(spark, "It was 5 [E9]", facts=False)[0] == "blocked"
    assert ladder(spark, "It was 5 [E9]", strict=False) == ("warning", "It was 5 [E9]\n\n> 引用校验警告\n- missing_evidence\n- unknown_reference: It was 5 [E9]")
    assert ladder(spark, None)[0] == "ledger"


DOC = "qid long, pos int, ref string, company string, fiscal_year string, content string, source_file string, item string, section string"


def test_listed_phrases(spark):
    a, b = ("; ".join(g) for g in direct.PHRASE_GROUPS)
    ev = spark.createDataFrame([(1, 1, "E1", "ko", "2024", a.upper(), "KO_2024.html", "Item 7", ""), (1, 2, "E2", "KO", "2022", a, "KO_2022.html", "", "MD&A"), (1, 3, "E3", "PEP", "2024", "first " + b, "PEP_2024.html", "Item 7", ""), (1, 4, "E4", "KO", "2023", b, "KO_2023.html", "", ""), (2, 1, "E1", "KO", "2024", a, "f", "", "")], DOC)
    q = spark.createDataFrame([(1, "How many distinct terms are mentioned?"), (2, "How many items and what amount?")], "qid long, question string")
    got = direct.listed_phrases(q, ev).collect()
    assert [r.qid for r in got] == [1] and got[0].answer.split("\n") == [
        "KO: 3 distinct items — 'actual results', 'financial position', 'cash generated from operations' [E2][E1]",
        "PEP: 3 distinct items — 'financial condition', 'results of operations', 'cash flows from operations' [E3]",
        "Total across all companies: 6 distinct terms — 'actual results', 'financial position', 'cash generated from operations', 'financial condition', 'results of operations', 'cash flows from operations' [E2][E1][E3]",
        "", "Sources:", "[E2] KO_2022.html — MD&A", "[E1] KO_2024.html — Item 7", "[E3] PEP_2024.html — Item 7",
    ]


def test_ages(spark):
    ev = spark.createDataFrame([(1, 1, "E1", "A", "2024", "Tim Cook, age 63, leads", "A_2024.html", "Item 10", "Officers"), (1, 2, "E2", "A", "2022", "Tim Cook (61)", "A_2022.html", "Item 10", "Officers"), (1, 3, "E3", "A", "2022", "Tim Cook 50", "x", "", ""), (1, 4, "E4", "A", "2023", "Tim Cook 17", "x", "", "")], DOC)
    q = spark.createDataFrame([(1, "By how much did the age of Tim Cook change?"), (2, "Tim Cook?")], "qid long, question string")
    assert [tuple(r) for r in direct.age_answers(q, ev).collect()] == [(1, "In FY2022, Tim Cook was 61 years old [E2]. In FY2024, Tim Cook was 63 years old [E1], an increase of 2 years from FY2022.\n\nSources:\n[E2] A_2022.html — Item 10 Officers\n[E1] A_2024.html — Item 10 Officers")]


def test_number_quote_line_start(spark):
    """A number right after a line break is quoted from there on, not from the text's start."""
    d = spark.createDataFrame([("first line\n123 units\nlast", 12, 3), ("a 7 b", 3, 1)], "c string, s int, l int")
    assert [r[0] for r in d.select(grounded.number_quote(F.col("c"), F.col("s"), F.col("l"))).collect()] == ["123 units", "a 7 b"]


def test_shuffled_by_question(spark):
    """Operands and documents meet by question, in one shuffle of each."""
    plan = registry.QUERIES["lg03_plan_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_phrases_in_one_pass(spark):
    """Documents of a question are read and gathered once, not for each part of the answer."""
    plan = registry.QUERIES["lg20_listed_phrases"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
