"""Evidence rows and questions with answers, made from order lines and orders, for the queries on evidence and answers.

They stand in for what retrieval and a model would give: a row of evidence for each order line, a question with expected
and predicted answers for each order. The expressions are ones that Spark and DuckDB read alike, so that a query and its
SQL start from the same rows; what is under test is computed on each side by its own means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .base import table


def _company(key: str) -> str:
    return f"CASE ({key}) % 5 WHEN 0 THEN 'ACME' WHEN 1 THEN 'BOLT' WHEN 2 THEN 'CYAN' WHEN 3 THEN 'DUNE' ELSE 'ECHO' END"


_LINES = {
    "qid": "l_orderkey",
    "pos": "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT)",
    "company": _company("l_suppkey"),
    "fiscal_year": "CAST(2020 + l_partkey % 5 AS INT)",
    "modality": "CASE WHEN (l_partkey + l_suppkey) % 2 = 0 THEN 'table' ELSE 'text' END",
    "item": "CASE l_partkey % 3 WHEN 0 THEN 'Item 7' WHEN 1 THEN 'Item 8' ELSE 'Item 1A' END",
    "metric": "CASE l_suppkey % 4 WHEN 0 THEN 'Net sales' WHEN 1 THEN 'Net income' WHEN 2 THEN 'Total assets' ELSE 'Operating income' END",
    "scale": "CASE WHEN l_partkey % 7 < 4 THEN 'million' WHEN l_partkey % 7 < 6 THEN 'thousand' ELSE 'billion' END",
    "amount": "CAST(l_extendedprice AS DECIMAL(12,2))",
    "prior": "CAST(l_quantity AS DECIMAL(12,2))",
    "score": "CAST(l_discount AS DECIMAL(4,2))",
    "fault": "CAST(l_partkey % 6 AS INT)",
}
_CONTENT = {
    "ref": "concat('E', CAST(pos AS STRING))",
    "source_file": "concat(company, '_', CAST(fiscal_year AS STRING), '.html')",
    "content": "CASE WHEN modality = 'table' THEN concat('Table header: ', metric, ' | FY', CAST(fiscal_year AS STRING), ' | in ', scale, 's', chr(10), '| ', metric, ' | ', CAST(amount AS STRING), ' | ', CAST(prior AS STRING), ' |') "
    "ELSE concat(company, ' reported ', lower(metric), ' of $', CAST(amount AS STRING), ' ', scale, ' for fiscal ', CAST(fiscal_year AS STRING), '. See ', item, '.') END",
}
_ORDERS = {
    "qid": "o_orderkey",
    "kind": "CAST(o_orderkey % 6 AS INT)",
    "company": _company("o_custkey"),
    "other": _company("o_custkey + 2"),
    "y1": "CAST(2020 + o_custkey % 4 AS STRING)",
    "y2": "CAST(2021 + o_custkey % 4 AS STRING)",
    "price": "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)",
    "thousands": "CAST(CAST(floor(o_totalprice / 1000) AS INT) AS STRING)",
    "pct": "CAST(o_custkey % 40 AS STRING)",
    "status": "o_orderstatus",
    "metric": "CASE o_orderkey % 3 WHEN 0 THEN 'Net sales' WHEN 1 THEN 'Net income' ELSE 'Total assets' END",
}
_ANSWERS = {
    "question": "CASE qid % 3 WHEN 0 THEN concat('What were net sales of ', company, ' in fiscal ', y1, ' and of ', other, ' in FY', y2, '?') "
    "WHEN 1 THEN concat('Compare net income for ', y1, ' and ', y2, ': ', company, ' against ', other, ', see Item 7') "
    "ELSE concat('How did total assets of ', company, ' change between ', y1, ' and ', y2, ' (', other, ' too), as Item 8 states?') END",
    "expected": "concat('Net sales were $', price, ' million in ', y1, ', up ', pct, '.5% over three years.')",
    "predicted": "CASE kind WHEN 0 THEN concat('**', company, '** net sales were $', price, ' million [E1][E2].', chr(10), 'Sources:', chr(10), '[E1] 10-K, 77 pages') "
    "WHEN 1 THEN concat('Net sales &amp; other were $', thousands, ' billion, up ', pct, '.5% [E1; F2] in ', y1, '.', chr(10), 'Over three fiscal years it was 12.') "
    "WHEN 2 THEN 'Insufficient evidence to determine the figure.' "
    "WHEN 3 THEN concat('1. It grew ', pct, '.4% to ', price, ' in FY', y2, ', E3', chr(10), other, ' is [E9].') "
    "WHEN 4 THEN '' "
    "ELSE concat('| Net sales | `', price, '` |', chr(10), '# Calculated (', thousands, ' - 5) for ', company, ' [C1] on March 3, ', y1, chr(10), company, ' had ', y2, ' items [E1]') END",
    "section": "CASE qid % 4 WHEN 0 THEN concat(company, ': Item 7; ', other, ': item 1a') WHEN 1 THEN 'Item 8 notes' WHEN 2 THEN '' ELSE concat('ZZZ: Item 9; ', company, ': Item 7A') END",
}


def _cte(name: str, source: str, first: dict[str, str], second: dict[str, str]) -> str:
    cols = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())
    return f"{name}0 AS (SELECT {cols(first)} FROM {source}), {name} AS (SELECT *, {cols(second)} FROM {name}0)"


#: The same rows in SQL, as ev and q.
EV_SQL = _cte("ev", "lineitem", _LINES, _CONTENT)
Q_SQL = _cte("q", "orders", _ORDERS, _ANSWERS)


def _made(df: DataFrame, first: dict[str, str], second: dict[str, str]) -> DataFrame:
    cols = lambda d: [e if e == n else f"{e} AS {n}" for n, e in d.items()]
    return df.selectExpr(*cols(first)).selectExpr("*", *cols(second))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    # numbered by the column that the rows keep, so that what groups or joins them by question needs no second shuffle
    lines = {**_LINES, "qid": "qid", "pos": _LINES["pos"].replace("PARTITION BY l_orderkey", "PARTITION BY qid")}
    return _made(table(spark, sf_dir, "lineitem").selectExpr("*", f"{_LINES['qid']} AS qid"), lines, _CONTENT)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(table(spark, sf_dir, "orders"), _ORDERS, _ANSWERS)
