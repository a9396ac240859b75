"""Patterns over a row's text are looked for once, and only in texts that can hold them."""

import pytest
from pyspark.sql import functions as F

from sievemark.functions import answers as A
from sievemark.functions import text as X
from sievemark.jobs import registry
from sievemark.operators import grounded

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,what,most", [("lg01_verified_facts", "regexp_replace(", 20), ("lg02_deterministic_facts", "regexp_extract_all(", 5), ("fl10_direct_value", "regexp_extract_all(", 2)])
def test_patterns(spark, name, what, most):
    assert registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count(what) <= most


def test_values(spark):
    rows = [(0, "a  b\t c\r\n"), (1, " x | 1,000 |"), (2, "t\n| Net sales (1) | 1, 2 |\n| b |\n"), (3, None), (4, "Rose 5%. Net income was\tflat in 2023.\nNet  sales were $3.")]
    d = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r for r in d.select("i", X.clean_line(F.col("t")).alias("c"), A.table_rows(F.col("t")).alias("r"), A.metric_name(F.col("t")).alias("n"), A.direct_value(F.lit("net income"), F.col("t")).alias("d")).collect()}
    assert [got[i].c for i in range(4)] == ["a b c", "x | 1,000 |", "t | Net sales (1) | 1, 2 | | b |", ""]
    assert [got[i].r for i in range(4)] == [[], [], ["| Net sales (1) | 1, 2 |"], None]
    assert got[0].n == "a b c" and got[1].n == "x 1 000" and got[4].d is False


def test_wanted_rows(spark):
    d = spark.createDataFrame([(1, "| Cash | 1 | (2) |\n| Debt | 3 |")], "qid long, content string")
    got = grounded.table_rows(d, wanted=F.col("label") == "Debt").collect()
    assert [(r.k, r.label, [int(v) for v in r["values"]]) for r in got] == [(1, "Debt", [3])]


def test_window_is_made_once(spark):
    """A document's text is lower-cased once for its window, not for each word that is looked for (F3)."""
    plan = registry.QUERIES["tx21_centred_window"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2 and plan.count("Lower") <= 2


def test_window_values(spark):
    """The longest word, of equal ones the first, that the text has; long runs without white space; texts that fit."""
    text = "x " * 100 + "alpha1 " + "y " * 100 + "bravo1 " + "z " * 100
    run = "r" * 300 + "\t" + "s" * 3000
    rows = [(1, text, "bravo1 alpha1"), (2, text, "alpha1 bravo1 missingword"), (3, text, "four none"), (4, run, "r" * 20), (5, run + " anchored", "anchored"), (6, None, "word"), (7, text, None), (8, " fits ", "fits")]
    got = {r.i: r.w for r in spark.createDataFrame(rows, "i int, t string, q string").select("i", X.centred_window(F.col("t"), F.col("q"), 60).alias("w")).collect()}
    assert got[1].startswith("... y y") and " bravo1 z" in got[1] and "alpha1" not in got[1]
    assert got[2].startswith("... x x") and " alpha1 y" in got[2]
    assert got[3] == got[7] == "x " * 28 + "..." and got[6] == "" and got[8] == "fits"
    assert got[4] == " ..." and got[5] == "... " + "s" * 52 + " ..."
