"""The audit asks first what costs least, with the results of its patterns."""

from pyspark.sql import functions as F

from sievemark.operators import audit

LINES = ["It was CALCULATED so", "computed", "计算得出 5", "按表计算", "按表", "(F1 / F2)", "(5 - 3)", "(see F1)", "5 - 3", "", "no", "Calc (ulated", "(a\n5 - 3)"]


def test_hints_of_derived_lines(spark):
    got = spark.createDataFrame([(x,) for x in LINES], "x string").select("x", audit.derives(F.col("x")).alias("a"), F.col("x").rlike(audit.DERIVED).alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.x for r in got if r.a} == {LINES[i] for i in (0, 1, 2, 3, 5, 6)}


def test_mixed_lines(spark):
    ev = spark.createDataFrame([(1, "E1", "ACME", 2023, ""), (1, "E2", None, None, "2021"), (2, None, "BETA", 2024, "")], "qid int, ref string, company string, year int, content string")
    calc = spark.createDataFrame([(1, "C1")], "qid int, ref string")
    ans = spark.createDataFrame([(1, "5 units [C1].\n6 units [C1][C2]\nACME in 2021 [e2]\nsources: 7\n(5 - 3) [E1] in 2023\n(5 - 3) [C1]"), (2, "BETA 5 [E1]")], "qid int, answer string")
    got = sorted(map(tuple, audit.citation_issues(ans, ev, calc).collect()))
    assert got == [
        (1, "company_mismatch", "ACME in 2021 [e2]"), (1, "uncited_numeric_claim", "6 units [C1][C2]"), (1, "unknown_reference", "6 units [C1][C2]"), (1, "unverified_calculation", "(5 - 3) [E1] in 2023"),
        (2, "company_mismatch", "BETA 5 [E1]"), (2, "missing_evidence", ""), (2, "unknown_reference", "BETA 5 [E1]"),
    ]
