"""Plans are made in one row for each question: what is known of it is dealt by question once."""

from sievemark.jobs import registry
from sievemark.operators import plans as P

SF = "/root/testdata/sf0.001"


def test_plans_dealt_once(spark):
    plan = registry.QUERIES["fu24_augmented"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # the other deal makes the found companies distinct
    assert plan.count("Exchange hashpartitioning(qid") <= 2 and "Window" not in plan


def test_mentions_by_place(spark):
    prompts = spark.createDataFrame([(1, "lin then LIN " + "x" * 45 + " 2022 ECL (2023)"), (2, None), (3, "nobody, 2024")], "qid long, prompt string")
    known = spark.createDataFrame([("LIN",), ("ECL",), ("LIN",)], "company string")
    got = sorted((r.qid, r.company, r.year) for r in P.company_mentions(prompts, known).collect())
    assert got == [(1, "ECL", "2023"), (1, "LIN", None), (1, "LIN", None)]
