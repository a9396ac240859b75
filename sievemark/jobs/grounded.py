"""Queries on facts without a model: what a question's words ask for, and a plan's operands found in the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import grounded
from .base import query
from .cases import EV_SQL, Q_SQL, evidence, questions

#: Documents say more on a third of the questions: rows and a sentence on cash, the latter in one of its wordings.
_CASH = (
    "concat(content, CASE WHEN qid % 3 = 0 THEN concat(chr(10), '| Cash and  cash equivalents | n/a | ', CAST(prior AS STRING), ' | ', CAST(amount AS STRING), ' |', chr(10), '| Short-term investments | (', CAST(amount AS STRING), ') | 1,', CAST(100 + pos AS STRING), ' |', "
    "CASE WHEN pos % 2 = 0 THEN concat(chr(10), '| Short-term investments | 7 |', chr(10), '| Total cash, cash equivalents, and short-term investments | none |', chr(10), 'Our cash , cash equivalents and short-term investments were about  $', CAST(amount AS STRING), ' Million then.') ELSE '' END) ELSE '' END)"
)
_ROWS = r"""rw AS (SELECT qid, pos, ref, company, fiscal_year, c, k, trim(regexp_replace(labels[k], '\s+', ' ', 'g')) AS label, list_filter(list_transform(regexp_extract_all(tails[k], '\(?\d[\d,]*(?:\.\d+)?\)?'), lambda n: CAST(regexp_replace(n, '[^0-9.]', '', 'g') AS DECIMAL(20,6)) * CASE WHEN starts_with(n, '(') AND ends_with(n, ')') THEN -1 ELSE 1 END), lambda v: v IS NOT NULL) AS vs, quotes[k] AS quote,
CASE WHEN contains(lower(c), 'in billions') THEN 'billion' WHEN contains(lower(c), 'in thousands') THEN 'thousand' ELSE 'million' END AS scale FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS k FROM (SELECT *, regexp_extract_all(c, '(?m)^\|\s*([^|]+?)\s*\|([^\r\n]+)$', 1) AS labels, regexp_extract_all(c, '(?m)^\|\s*([^|]+?)\s*\|([^\r\n]+)$', 2) AS tails, regexp_extract_all(c, '(?m)^\|\s*([^|]+?)\s*\|([^\r\n]+)$') AS quotes FROM dc)))"""
_FACTOR = "CASE {0} WHEN 'billion' THEN 1000000000 WHEN 'million' THEN 1000000 WHEN 'thousand' THEN 1000 ELSE 1 END"
#: A question on net income states 1.05, 1.07 or 1.5 times the least that a table's row has, in millions.
_SHARE = "CAST(CASE qid % 6 WHEN 0 THEN 1.05 WHEN 2 THEN 1.07 ELSE 1.5 END AS DECIMAL(4,2))"
_STATED = f"CAST(CAST(least_base * {_SHARE} / 1000000 AS DECIMAL(20,4)) AS STRING)"
_QUESTION = f"concat(CASE WHEN qid % 3 = 0 THEN 'What is total cash and what are  short-term investments? ' ELSE '' END, CASE WHEN least_base IS NULL THEN 'And income?' ELSE concat('Given that Net Income for fiscal year ', CAST(y AS STRING), ' is $', {_STATED}, ' million, what changed?') END)"
_ASKED_SQL = f"ab AS (SELECT qid, min(CAST(amount * {_FACTOR.format('scale')} AS DECIMAL(30,2))) FILTER (WHERE metric = 'Net income' AND modality = 'table') AS least_base, min(fiscal_year) AS y FROM ev WHERE qid % 2 = 0 OR qid % 3 = 0 GROUP BY qid), aq AS (SELECT qid, y, CASE WHEN qid % 2 = 0 THEN least_base END AS least_base FROM ab)"


def asked(spark, sf_dir) -> DataFrame:
    base = F.expr(f"CAST(amount * {_FACTOR.format('scale')} AS DECIMAL(30,2))")
    found = F.when((F.col("metric") == "Net income") & (F.col("modality") == "table") & (F.col("qid") % 2 == 0), base)
    least = evidence(spark, sf_dir).where("qid % 2 = 0 or qid % 3 = 0").groupBy("qid").agg(F.min(found).alias("least_base"), F.min("fiscal_year").alias("y"))
    return least.select("qid", F.expr(_QUESTION).alias("question"))


@query("lg02_deterministic_facts", rf"""WITH {EV_SQL}, {_ASKED_SQL}, dc AS (SELECT qid, pos, ref, company, fiscal_year, {_CASH} AS c FROM ev WHERE qid IN (SELECT qid FROM aq)), {_ROWS},
wh AS (SELECT *, list_position(['cash and cash equivalents', 'short-term investments', 'total cash, cash equivalents, and short-term investments'], lower(label)) AS w FROM rw WHERE qid % 3 = 0), c1 AS (SELECT * FROM wh WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY qid, ref, w ORDER BY k) = 1),
sa AS (SELECT qid, pos, ref, company, fiscal_year, regexp_extract(c, '(?i)(cash\s*,?\s*cash equivalents\s*,?\s*(?:and\s+)?short-term investments)(?:\s+\w+){{0,10}}\s+\$?([\d,.]+)\s+(million|billion)') AS quote, regexp_extract(c, '(?i)short-term investments(?:\s+\w+){{0,10}}\s+\$?([\d,.]+)\s+(million|billion)', 1) AS v FROM dc WHERE qid % 3 = 0),
st AS (SELECT qid, y, CAST(CAST(least_base * {_SHARE} / 1000000 AS DECIMAL(20,4)) AS DECIMAL(28,4)) * 1000000 AS stated FROM aq WHERE least_base IS NOT NULL),
ne AS (SELECT rw.*, y, abs(CAST(vs[1] * {_FACTOR.format('scale')} AS DECIMAL(30,6)) - stated) AS gap, stated FROM rw JOIN st USING (qid) WHERE lower(label) = 'net income' AND len(vs) >= 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY gap, pos, k) = 1),
al AS (SELECT qid, 0 AS kind, pos, w, ref, company, fiscal_year, label AS metric, vs[1] AS v, scale, quote FROM c1 WHERE len(vs) > 0 UNION ALL SELECT qid, 0, pos, 4, ref, company, fiscal_year, 'Total cash, cash equivalents, and short-term investments', CAST(v AS DECIMAL(20,6)), 'million', trim(regexp_replace(quote, '\s+', ' ', 'g')) FROM sa WHERE quote <> ''
UNION ALL SELECT qid, 1, pos, 100, ref, company, y, label, vs[1], scale, quote FROM ne WHERE gap <= stated * 0.08 UNION ALL SELECT qid, 1, pos, 101, ref, company, y - 1, label, vs[2], scale, quote FROM ne WHERE gap <= stated * 0.08),
un AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY qid, CASE WHEN w IN (3, 4) THEN 'total' ELSE lower(metric) END, v, company, fiscal_year ORDER BY kind, pos, w) = 1)
SELECT qid, 'F' || CAST(row_number() OVER (PARTITION BY qid ORDER BY kind, pos, w) AS VARCHAR) AS fact_id, ref, company, CAST(fiscal_year AS VARCHAR) AS fiscal_year, metric, '$' || CASE WHEN v = 0 THEN '0' ELSE regexp_replace(regexp_replace(CAST(v AS VARCHAR), '0+$', ''), '\.$', '') END || ' ' || scale AS raw_value, CAST(v AS DOUBLE) AS value, scale, md5(quote) AS quote_md5 FROM un""")
def lg02(spark, sf_dir):
    """Facts that questions on cash, and questions that take a net income for granted, name themselves."""
    ev = evidence(spark, sf_dir).select("qid", "pos", "ref", "company", F.col("fiscal_year").cast("string").alias("fiscal_year"), F.expr(_CASH).alias("content"))
    facts = grounded.deterministic_facts(asked(spark, sf_dir), ev)
    return facts.select("qid", "fact_id", "ref", "company", "fiscal_year", "metric", "raw_value", F.col("value").cast("double").alias("value"), "scale", F.md5("quote").alias("quote_md5"))


#: Operands of a question, by its first row of evidence: found by task, by any task, under another metric, not at all, by
#: company and year beside an unknown task, a count, and without a company.
_OPERANDS = [
    ("'SUM'", "'t1'", "lower(company)", "CAST(fiscal_year AS STRING)", "metric", "concat('$', CAST(amount AS STRING), '0')", "'unit'"),
    ("'SUM'", "''", "''", "''", "metric", "CAST(prior AS STRING)", "'Thousands'"),
    ("'SUM'", "'t1'", "company", "''", "'Total liabilities'", "CAST(amount AS STRING)", "''"),
    ("'SUM'", "''", "''", "''", "metric", "'999,999,999.5'", "''"),
    ("'DIFFERENCE'", "'t99'", "company", "CAST(fiscal_year AS STRING)", "CASE WHEN qid % 2 = 0 THEN upper(metric) ELSE metric END", "concat('(', CAST(amount AS STRING), ' and more')", "''"),
    ("'count'", "''", "''", "''", "metric", "CAST(amount AS STRING)", "''"),
    ("'SUM'", "'t99'", "''", "CAST(fiscal_year AS STRING)", "metric", "CAST(amount AS STRING)", "''"),
    ("'SUM'", "'t2'", "''", "'2001'", "' '", "CAST(amount AS STRING)", "''"),
]
_NAMES = ["operator", "task", "company", "year", "metric", "raw_value", "scale"]
_OPERANDS_SQL = "op AS (" + " UNION ALL ".join(f"SELECT qid, 'p' AS plan, {i + 1} AS at_, " + ", ".join(f"{e} AS {n}" for e, n in zip(r, ["o_operator", "o_task", "o_company", "o_year", "o_metric", "raw_value", "proposed"])) + " FROM ev WHERE pos = 1" for i, r in enumerate(_OPERANDS)) + ")"


@query("lg03_plan_facts", rf"""WITH {EV_SQL}, {_OPERANDS_SQL}, n AS (SELECT *, TRY_CAST(replace(regexp_extract(raw_value, '\d[\d,]*(?:\.\d+)?'), ',', '') AS DECIMAL(20,6)) AS number FROM op WHERE lower(o_operator) <> 'count' AND trim(o_metric) <> ''),
ln AS (SELECT qid, pos, ref, company, fiscal_year, modality, scale, metric, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS l FROM ev), nm AS (SELECT *, list_transform(regexp_extract_all(line, '\d[\d,]*(?:\.\d+)?'), lambda x: CAST(replace(x, ',', '') AS DECIMAL(20,6))) AS ns FROM ln),
m AS (SELECT n.*, nm.* EXCLUDE qid, CASE WHEN o_task = '' OR o_task = 't' || CAST(pos AS VARCHAR) THEN 0 ELSE 1 END AS tier FROM n JOIN nm ON n.qid = nm.qid AND list_contains(ns, number) AND (o_company = '' OR upper(o_company) = company) QUALIFY row_number() OVER (PARTITION BY n.qid, at_, ref ORDER BY l) = 1),
f AS (SELECT *, starts_with(line, '| ') AS row FROM m WHERE (tier = 0 OR (o_company <> '' AND o_year <> '' AND o_year = CAST(fiscal_year AS VARCHAR))) AND CASE WHEN starts_with(line, '| ') AND list_contains(list_transform(regexp_extract_all(regexp_extract(line, '^\|\s*[^|]+\|(.*)$', 1), '\d[\d,]*(?:\.\d+)?'), lambda x: CAST(replace(x, ',', '') AS DECIMAL(20,6))), number) THEN lower(o_metric) = lower(metric) ELSE contains(lower(line), lower(o_metric)) END),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY qid, at_ ORDER BY tier, pos) = 1), c AS (SELECT *, CASE WHEN o_company = '' THEN company ELSE o_company END AS co, CASE WHEN o_year = '' THEN CAST(fiscal_year AS VARCHAR) ELSE o_year END AS fy FROM b), u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid, lower(o_metric), number, upper(co), fy ORDER BY at_) = 1)
SELECT qid, 'F' || CAST(row_number() OVER (PARTITION BY qid ORDER BY at_) AS VARCHAR) AS fact_id, ref, co AS company, fy AS fiscal_year, o_metric AS metric, raw_value, CAST(number AS DOUBLE) AS value, CASE WHEN row THEN scale WHEN regexp_matches(line, '(^|[^0-9,.])' || regexp_replace(CAST(CAST(number AS DECIMAL(20,2)) AS VARCHAR), '\.', '\\.') || ' (thousand|million|billion)') THEN scale WHEN proposed = 'Thousands' THEN 'thousand' ELSE 'unit' END AS scale, md5(trim(line)) AS quote_md5 FROM u""")
def lg03(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    cols = lambda r: ", ".join(f"{e} AS {n}" for e, n in zip(r, _NAMES))
    each = F.array(*[F.expr(f"struct({i + 1} AS pos, {cols(r)})") for i, r in enumerate(_OPERANDS)])
    operands = ev.where("pos = 1").select("qid", F.lit("p").alias("plan"), F.explode(each).alias("x")).select("qid", "plan", "x.*")
    docs = ev.select("qid", "pos", "ref", "company", F.col("fiscal_year").cast("string").alias("fiscal_year"), "content", F.array(F.concat(F.lit("t"), F.col("pos").cast("string"))).alias("tasks"))
    facts = grounded.plan_facts(operands, docs)
    return facts.select("qid", "fact_id", "ref", "company", "fiscal_year", "metric", "raw_value", F.col("value").cast("double").alias("value"), "scale", F.md5("quote").alias("quote_md5"))
