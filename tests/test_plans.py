"""Golden values of plans: stated scopes, the fallback dealt over scopes, anchors, bindings."""

from sievemark.operators import plans as P

TASK = "qid long, pos int, id string, query string, companies array<string>, years array<string>, metric string, operation string, modality string"


def _known(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "company string")


def test_scopes_without_cross_product(spark):
    prompts = spark.createDataFrame([(1, "Compare LIN in FY2024 with ECL's FY2022 filing."), (2, "In 2023, and even before 2022, lin grew; ECL-B and XECL did not 2024"), (3, None), (4, "ECL" + " " * 36 + "2024, LIN" + " " * 37 + "2023")], "qid long, prompt string")
    got = {r.qid: [tuple(x) for x in r.scopes] for r in P.scopes(P.company_mentions(prompts, _known(spark, "LIN", "ECL"))).collect()}
    assert got[1] == [("LIN", "2024"), ("ECL", "2022")]
    # the year after wins over those before, within 40 characters
    assert got[2] == [("LIN", "2022")] or got[2] == [("LIN", "2024")]
    # a year that begins within 40 characters but ends beyond them doesn't count; the one before the name does
    assert got[4] == [("ECL", "2024"), ("LIN", "2024")]
    assert 3 not in got


def test_fallback_over_scopes(spark):
    prompts = spark.createDataFrame([(1, "How did LLY in 2022, LLY in 2024, PFE in 2022 and PFE in 2024 compare in Item 7?")], "qid long, prompt string")
    tasks = spark.createDataFrame([(1, 1, "retrieve_1", "compare forward-looking language in Item 7", [], ["2022", "2024"], "", "retrieve", "hybrid")], TASK)
    none = spark.createDataFrame([], "qid long, company string")
    out = P.augmented(prompts, tasks, _known(spark, "LLY", "PFE"), none).orderBy("pos").collect()
    assert [r.id for r in out] == ["retrieve_scope_lly_2022", "retrieve_scope_lly_2024", "retrieve_scope_pfe_2022", "retrieve_scope_pfe_2024"]
    assert all(len(r.companies) == len(r.years) == 1 for r in out) and out[0].query == "LLY FY2022 compare forward-looking language in Item 7"


def test_anchor_and_single_company(spark):
    prompts = spark.createDataFrame([(1, "With $5.2 million for LIN in FY2024, what is the increase?"), (2, "What did they earn?")], "qid long, prompt string")
    tasks = spark.createDataFrame([(q, 1, "t", "net income", [], ["2024"], "net income", "retrieve", "table") for q in (1, 2)] + [(1, 2, "c", "x", [], [], "", "calculate", "table")], TASK)
    none = spark.createDataFrame([], "qid long, company string")
    out = {(r.qid, r.id): r for r in P.augmented(prompts, tasks, _known(spark, "LIN"), none).collect()}
    assert sorted(out) == [(1, "c"), (1, "retrieve_explicit_lin_2024_anchor"), (1, "t"), (2, "t")]
    assert out[1, "t"].companies == ["LIN"] and out[1, "c"].companies == [] and out[2, "t"].companies == []


def test_item_scope(spark):
    prompts = spark.createDataFrame([(1, "See item  7a, please")], "qid long, prompt string")
    rows = [(1, i, f"t{i}", q, [], [], m, o, "text") for i, (q, m, o) in enumerate([("risk in item 1A", "", "retrieve"), ("market risk", "", "retrieve"), ("officer age", "", "retrieve"), ("risk in item 1A", "", "calculate"), ("additional information on sales data", "", "retrieve")])]
    out = P.augmented(prompts, spark.createDataFrame(rows, TASK), _known(spark, "LIN"), spark.createDataFrame([], "qid long, company string")).orderBy("pos").collect()
    assert [r.query for r in out] == ["risk in Item 7A", "market risk Item 7A", "officer age", "risk in item 1A", "additional information on sales data"]


def test_bindings(spark):
    tasks = spark.createDataFrame([
        (1, 1, "a", "revenue of LIN", ["LIN"], ["2023"], "net revenue", "retrieve", "table"), (1, 2, "b", "assets", ["LIN"], ["2023"], "total assets", "retrieve", "table"),
        (1, 3, "c", "anything", [], [], "", "retrieve", "table"), (1, 4, "d", "net revenue total assets", [], [], "", "calculate", "table"),
    ], TASK)
    operands = spark.createDataFrame([(1, "p", "SUM", 1, "x", "d", "lin", "2023", "total assets"), (1, "p", "SUM", 2, "x", "c", "LIN", "2023", "total assets"), (1, "p", "SUM", 3, "x", "none", "ECL", "2023", "assets"), (2, "p", "SUM", 1, "x", "gone", "", "", "assets")], "qid long, plan string, operator string, pos int, role string, task string, company string, year string, metric string")
    assert {(r.qid, r.pos): r.task for r in P.rebound(operands, tasks).collect()} == {(1, 1): "b", (1, 2): "c", (1, 3): "c", (2, 1): "gone"}
    # the closest pair first; the second operand on assets has to take another task, the third what is left for it
    assert {r.pos: r.task for r in P.one_to_one(operands, tasks).collect()} == {1: "b", 2: "a", 3: "c"}
