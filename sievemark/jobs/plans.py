"""Queries on plans: scopes that prompts state, tasks made to cover them, operands bound to tasks, trends and counts.

Prompts and tasks are made from the questions of cases, by expressions that both engines read alike; a list is a string
parted by bars until it is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import plans as P
from .base import query
from .cases import Q_SQL, questions
from .texts import TOK

_PROMPT = "concat(question, CASE WHEN qid % 5 = 0 THEN ' Net sales of $5.2 million are given; what is the increase?' ELSE '' END, CASE WHEN qid % 7 = 0 THEN ' Dataset retrieval  scope (metadata only): ACME 2022' ELSE '' END)"
#: id, query, companies, years, metric, operation of the tasks of a question, in order.
_TASKS = [
    ("CASE WHEN qid % 2 = 0 THEN 'retrieve_1' ELSE 'retrieve_main' END", "concat('compare ', lower(metric), ' in item  9b')", "CASE qid % 3 WHEN 0 THEN '' WHEN 1 THEN company ELSE 'Unknown Corp' END", "y1", "''", "'retrieve'"),
    ("'retrieve_age'", "'officer age'", "lower(company)", "''", "'age'", "'retrieve'"),
    ("concat('retrieve_', lower(other))", "concat(metric, ' of ', other, CASE WHEN qid % 9 = 0 THEN ' in the referenced table of segment detail' ELSE '' END)", "other", "y2", "metric", "'Retrieve'"),
    ("'calculate_1'", "'net change'", "''", "''", "metric", "'calculate'"),
]
#: plan, operator, role, task, company, year, metric of the operands of a question, in order.
_OPERATOR = "CASE qid % 4 WHEN 0 THEN 'PERCENT_CHANGE' WHEN 1 THEN 'DIFFERENCE' WHEN 2 THEN 'COUNT' ELSE 'CAGR' END"
_OPERANDS = [
    ("'p1'", _OPERATOR, "'start'", "CASE WHEN qid % 3 = 0 THEN 'unknown' ELSE 'retrieve_age' END", "company", "y1", "metric"),
    ("'p1'", _OPERATOR, "'end'", "concat('retrieve_', lower(other))", "lower(other)", "y2", "metric"),
    ("'p2'", "'SUM'", "'part'", "'calculate_1'", "''", "''", "'officer age compared'"),
]
#: A series of one company and metric in three tasks, with a gap between the first two, and an operand pair of some.
_SERIES = [(f"concat('r', CAST(CAST(y1 AS INT) + {n} AS STRING))", "concat('table header years 2019, 2020 and ', y1)", company, f"CAST(CAST(y1 AS INT) + {n} AS STRING)", metric, "'retrieve'") for n, company, metric in ((3, "lower(company)", "metric"), (0, "company", "concat(' ', upper(metric))"), (2, "company", "metric"), (2, "company", "''"))]
_PAIR = [("CASE WHEN qid % 3 = 0 THEN 'a' ELSE 'b' END", "'PERCENT_CHANGE'", "'start'", "concat('R', y1)", "company", "y1", "metric"), ("'a'", "'PERCENT_CHANGE'", "'end'", "concat('r', CAST(CAST(y1 AS INT) + 2 AS STRING))", "company", "y1", "metric"), ("'c'", "'COUNT'", "'record'", "concat('r', CAST(CAST(y1 AS INT) + 3 AS STRING))", "company", "y1", "metric")]
_TASK_NAMES, _OPERAND_NAMES = ["id", "query", "companies", "years", "metric", "operation"], ["plan", "operator", "role", "task", "company", "year", "metric"]


def _sql(name: str, rows: list[tuple], names: list[str], lists: tuple[str, ...] = ()) -> str:
    cols = lambda r: ", ".join(f"list_filter(string_split({e}, '|'), lambda x: x <> '') AS {n}" if n in lists else f"{e} AS {n}" for e, n in zip(r, names))
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT qid, {i + 1} AS pos, {cols(r)} FROM q" for i, r in enumerate(rows)) + ")"


def _rows(q: DataFrame, rows: list[tuple], names: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    each = F.array(*[F.expr(f"struct({i + 1} AS pos, " + ", ".join(f"{e} AS {n}" for e, n in zip(r, names)) + ")") for i, r in enumerate(rows)])
    out = q.select("qid", F.explode(each).alias("x")).select("qid", "x.*")
    return out.withColumns({c: F.filter(F.split(c, r"\|"), lambda x: x != "") for c in lists})


_LISTS = ("companies", "years")
TASKS_SQL, OPERANDS_SQL = _sql("tk", _TASKS, _TASK_NAMES, _LISTS), _sql("op", _OPERANDS, _OPERAND_NAMES)


def tasks(spark, sf_dir) -> DataFrame:
    return _rows(questions(spark, sf_dir), _TASKS, _TASK_NAMES, _LISTS).withColumn("modality", F.lit("table"))


def operands(spark, sf_dir) -> DataFrame:
    return _rows(questions(spark, sf_dir), _OPERANDS, _OPERAND_NAMES)


def prompts(spark, sf_dir) -> DataFrame:
    return questions(spark, sf_dir).select("qid", F.expr(_PROMPT).alias("prompt"))


def known(spark, sf_dir) -> DataFrame:
    return questions(spark, sf_dir).select("company").distinct()


#: Mentions and years by their places in the prompt, joined where they stand near.
SCOPES_SQL = f"""pr AS (SELECT *, {_PROMPT} AS prompt FROM q), ch AS (SELECT qid, ' ' || prompt || ' ' AS p, unnest(range(2, length(prompt) + 2)) AS i FROM pr),
me AS (SELECT qid, i AS s, i + 4 AS e, upper(substr(p, i, 4)) AS company FROM ch WHERE upper(substr(p, i, 4)) IN (SELECT DISTINCT company FROM q) AND NOT regexp_matches(substr(p, i - 1, 1) || substr(p, i + 4, 1), '[A-Za-z0-9-]')),
ye AS (SELECT qid, i AS s, substr(p, i, 4) AS year FROM ch WHERE substr(p, i, 4) IN ('2022', '2023', '2024') AND NOT regexp_matches(substr(p, i - 1, 1) || substr(p, i + 4, 1), '[0-9]')),
my AS (SELECT me.qid, me.s, company, coalesce(arg_min(y.year, y.s) FILTER (WHERE y.s >= me.e AND y.s + 4 <= me.e + 40), arg_max(y.year, y.s) FILTER (WHERE y.s + 4 <= me.s AND y.s >= me.s - 40)) AS year FROM me LEFT JOIN ye y USING (qid) GROUP BY ALL),
sc AS (SELECT qid, company, year, min(s) AS s FROM my WHERE year IS NOT NULL GROUP BY ALL)"""


@query("fu24_scopes", f"WITH {Q_SQL}, {SCOPES_SQL} SELECT qid, company, year, CAST(row_number() OVER (PARTITION BY qid ORDER BY s) AS INT) AS pos FROM sc")
def fu24_scopes(spark, sf_dir):
    """Company-year pairs that a prompt states within 40 characters of each other, in order."""
    found = P.scopes(P.company_mentions(prompts(spark, sf_dir), known(spark, sf_dir)))
    return found.select("qid", F.posexplode("scopes").alias("pos", "x")).select("qid", "x.company", "x.year", (F.col("pos") + 1).alias("pos"))


_BARE = r"trim(regexp_replace(regexp_replace({0}, '(?is)\s*dataset\s+retrieval\s+scope\s*\(metadata\s+only\)\s*:.*$', ''), '\s+', ' ', 'g'))"
_ITEM = r"regexp_extract(regexp_replace({0}, '\s+', ' ', 'g'), '(?i)\bitem\s+(\d+[A-Z]?)\b', 1)"


@query("fu24_augmented", rf"""WITH {Q_SQL}, {SCOPES_SQL}, {TASKS_SQL}, nd AS (SELECT qid, other AS company FROM q WHERE qid % 11 = 0 UNION SELECT qid, company FROM q WHERE qid % 33 = 0),
n1 AS (SELECT qid, any_value(company) AS company FROM nd GROUP BY qid HAVING count(*) = 1), yd AS (SELECT qid, year, min(s) AS s FROM ye GROUP BY ALL),
sx AS (SELECT qid, company, year, row_number() OVER (PARTITION BY qid ORDER BY s, k) AS k FROM (SELECT qid, company, year, s, 0 AS k FROM sc UNION ALL SELECT qid, company, year, dense_rank() OVER (PARTITION BY qid ORDER BY company), s FROM nd JOIN yd USING (qid) WHERE qid NOT IN (SELECT qid FROM sc))),
hi AS (SELECT qid, list(DISTINCT company) AS h FROM (SELECT qid, company FROM me UNION ALL SELECT qid, company FROM nd) GROUP BY qid), kn AS (SELECT list(DISTINCT company) AS ks FROM q),
tb AS (SELECT tk.* EXCLUDE companies, CASE WHEN lower(operation) = 'retrieve' AND len(h) = 1 THEN h WHEN lower(operation) = 'retrieve' AND n1.company IS NOT NULL AND len(list_filter(companies, lambda c: list_contains(ks, upper(c)))) = 0 THEN [n1.company] ELSE companies END AS companies FROM tk LEFT JOIN hi USING (qid) LEFT JOIN n1 USING (qid) CROSS JOIN kn),
fa AS (SELECT qid, query, metric FROM tb WHERE id = 'retrieve_1' AND qid IN (SELECT qid FROM sx)), kt AS (SELECT * FROM tb WHERE NOT (id = 'retrieve_1' AND qid IN (SELECT qid FROM fa))),
cv AS (SELECT DISTINCT qid, upper(c) AS company, y AS year FROM (SELECT qid, c, unnest(years) AS y FROM (SELECT qid, years, unnest(companies) AS c FROM kt WHERE lower(operation) = 'retrieve')) UNION SELECT qid, company, year FROM sx WHERE qid IN (SELECT qid FROM fa)),
al AS (SELECT qid, 0 AS stage, pos, id, query, companies, years, metric, operation, 'table' AS modality FROM kt
UNION ALL SELECT qid, 1, k, 'retrieve_scope_' || lower(company) || '_' || year, company || ' FY' || year || ' ' || {_BARE.format('query')}, [company], [year], metric, 'retrieve', 'table' FROM sx JOIN fa USING (qid)
UNION ALL SELECT sx.qid, 2, k, 'retrieve_explicit_' || lower(sx.company) || '_' || sx.year || CASE WHEN cv.qid IS NULL THEN '' ELSE '_anchor' END, sx.company || ' FY' || sx.year || ' ' || {_BARE.format('prompt')}, [sx.company], [sx.year], '', 'retrieve', 'hybrid' FROM sx JOIN pr USING (qid) LEFT JOIN cv ON cv.qid = sx.qid AND cv.company = sx.company AND cv.year = sx.year WHERE cv.qid IS NULL OR sx.qid % 5 = 0),
qi AS (SELECT qid, CASE WHEN {_ITEM.format('prompt')} = '' THEN '' ELSE 'Item ' || upper({_ITEM.format('prompt')}) END AS item FROM pr),
rw AS (SELECT al.*, item, lower(operation) = 'retrieve' AND item <> '' AND NOT (metric = 'age' OR contains(lower(query), 'referenced table')) AS bound, regexp_replace(query, '(?i)\bitem\s+\d+[A-Z]?\b', item, 'g') AS named FROM al JOIN qi USING (qid))
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY stage, pos) AS INT) AS pos, id, CASE WHEN NOT bound THEN query WHEN {_ITEM.format('named')} = '' THEN trim(regexp_replace(named || ' ' || item, '\s+', ' ', 'g')) ELSE named END AS query, array_to_string(companies, '|') AS companies, array_to_string(years, '|') AS years, metric, modality FROM rw""")
def fu24(spark, sf_dir):
    """Plans made to cover what their prompts state; an eleventh has a company from a search for names, some two."""
    q = questions(spark, sf_dir)
    found = q.where("qid % 11 = 0").select("qid", F.col("other").alias("company")).union(q.where("qid % 33 = 0").select("qid", "company")).distinct()
    out = P.augmented(prompts(spark, sf_dir), tasks(spark, sf_dir), known(spark, sf_dir), found)
    return out.select("qid", "pos", "id", "query", F.array_join("companies", "|").alias("companies"), F.array_join("years", "|").alias("years"), "metric", "modality")


_COVERS = "lower(t.operation) = 'retrieve' AND (o.company = '' OR len(t.companies) = 0 OR len(list_filter(t.companies, lambda c: lower(c) = lower(o.company))) > 0) AND (o.year = '' OR len(t.years) = 0 OR list_contains(t.years, o.year))"
_AFFINITY = f"len(list_intersect({TOK.format('o.metric')}, {TOK.format('concat_ws(chr(32), t.metric, t.query)')}))"
_FITS = f"ft AS (SELECT o.qid, o.plan, o.pos, t.pos AS place, t.id, {_AFFINITY} AS n FROM op o JOIN tk t ON o.qid = t.qid AND {_COVERS})"


@query("fu23_rebound", f"WITH {Q_SQL}, {TASKS_SQL}, {OPERANDS_SQL}, {_FITS}, b AS (SELECT qid, plan, pos, arg_min(id, place) AS id FROM (SELECT *, max(n) OVER (PARTITION BY qid, plan, pos) AS most FROM ft) WHERE n = most GROUP BY ALL), k AS (SELECT DISTINCT o.qid, o.plan, o.pos FROM op o JOIN ft ON o.qid = ft.qid AND o.plan = ft.plan AND o.pos = ft.pos AND o.task = ft.id) SELECT o.qid, o.plan, o.pos, o.role, CASE WHEN k.qid IS NOT NULL THEN o.task ELSE coalesce(b.id, o.task) END AS task FROM op o LEFT JOIN b USING (qid, plan, pos) LEFT JOIN k USING (qid, plan, pos)")
def fu23_rebound(spark, sf_dir):
    """Operands whose task doesn't cover them, bound to the task that does and whose words are closest."""
    return P.rebound(operands(spark, sf_dir), tasks(spark, sf_dir)).select("qid", "plan", "pos", "role", "task")


@query("fu23_one_to_one", f"WITH RECURSIVE {Q_SQL}, {TASKS_SQL}, {OPERANDS_SQL}, {_FITS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, plan, pos, place) AS k FROM ft), g(qid, k, os, ts) AS (SELECT DISTINCT qid, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM r UNION ALL SELECT g.qid, r.k, CASE WHEN list_contains(os, r.pos) OR list_contains(ts, r.place) THEN os ELSE list_append(os, r.pos) END, CASE WHEN list_contains(os, r.pos) OR list_contains(ts, r.place) THEN ts ELSE list_append(ts, r.place) END FROM g JOIN r ON r.qid = g.qid AND r.k = g.k + 1), z AS (SELECT qid, arg_max(os, k) AS os, arg_max(ts, k) AS ts FROM g GROUP BY qid), y AS (SELECT qid, unnest(os) AS pos, unnest(ts) AS place FROM z) SELECT r.qid, r.plan, r.pos, r.id AS task FROM y JOIN r USING (qid, pos, place)")
def fu23_one_to_one(spark, sf_dir):
    """Each operand with a task of its own, the closest pairs first."""
    return P.one_to_one(operands(spark, sf_dir), tasks(spark, sf_dir))


@query("fu23_requested", f"WITH {Q_SQL}, {OPERANDS_SQL} SELECT op.qid, plan, operator, op.pos FROM op WHERE operator NOT IN ('PERCENT_CHANGE', 'CAGR') OR (operator = 'CAGR' AND qid % 3 = 1) OR (operator = 'PERCENT_CHANGE' AND (qid % 5 = 0 OR qid % 3 = 1))")
def fu23_requested(spark, sf_dir):
    """Plans without the percent changes and compound rates that their prompts don't ask for."""
    said = prompts(spark, sf_dir).select("qid", F.concat("prompt", F.when(F.col("qid") % 3 == 1, " As an annualized  growth rate?").otherwise(""), F.when(F.col("qid") % 5 == 0, " In % change?").otherwise("")).alias("prompt"))
    # a scope that a dataset adds at the end would hide what follows, so that it is taken off here
    said = said.select("qid", F.regexp_replace("prompt", r"Dataset retrieval  scope \(metadata only\):", "").alias("prompt"))
    return P.requested_operators(said, operands(spark, sf_dir)).select("qid", "plan", "operator", "pos")


_SERIES_SQL, _PAIR_SQL = _sql("tk", _SERIES, _TASK_NAMES, _LISTS), _sql("op", _PAIR, _OPERAND_NAMES)


@query("fu23_trend_gaps", f"WITH {Q_SQL} SELECT qid, 'calculate_trend_' || lower(company) || '_' || a || '_' || b AS plan, 'r' || a AS start, 'r' || b AS end, a AS from_year, b AS to_year FROM (SELECT qid, company, CAST(CAST(y1 AS INT) + unnest([0, 2]) AS VARCHAR) AS a, CAST(CAST(y1 AS INT) + unnest([2, 3]) AS VARCHAR) AS b FROM q) WHERE NOT (qid % 3 = 0 AND CAST(b AS INT) - CAST(a AS INT) = 2)")
def fu23_trend(spark, sf_dir):
    """Changes along a series of tasks, also over years that it lacks; a third of the questions plan one of them already."""
    q = questions(spark, sf_dir)
    return P.trend_plans(_rows(q, _SERIES, _TASK_NAMES, _LISTS), _rows(q, _PAIR, _OPERAND_NAMES))


@query("fu23_counts", f"WITH {Q_SQL}, {_SERIES_SQL}, {_PAIR_SQL} SELECT tk.qid, 'count_' || tk.id AS plan, tk.id AS task, CASE WHEN y1 = '2020' THEN '2019|2020' ELSE '2019|2020|' || y1 END AS years FROM tk JOIN q USING (qid) WHERE NOT EXISTS (SELECT 1 FROM op WHERE op.qid = tk.qid AND operator = 'COUNT' AND lower(op.task) = lower(tk.id))")
def fu23_counts(spark, sf_dir):
    """Counts of the years that a task on a table's header names."""
    q = questions(spark, sf_dir)
    found = P.count_plans(_rows(q, _SERIES, _TASK_NAMES, _LISTS), _rows(q, _PAIR, _OPERAND_NAMES))
    return found.withColumn("years", F.array_join("years", "|"))


_ADDED = ", ".join(f"CASE WHEN contains(lower(p), '{k}') THEN '{v}' END" for k, v in A.SYNONYMS)


@query("fu22_fallback_queries", rf"WITH {Q_SQL}, b AS (SELECT qid, {_BARE.format(_PROMPT)} AS p FROM q), e AS (SELECT qid, p, concat_ws(' ', p, {_ADDED}) AS x FROM b), l AS (SELECT qid, [p, x, p || ' annual report 10-K', p || ' consolidated financial statements', p || ' table fiscal year period'] AS l FROM e) SELECT qid, md5(array_to_string(list_filter(l, lambda v, i: NOT list_contains(list_transform(l[1:i-1], lambda w: lower(w)), lower(v)))[1:5], chr(10))) AS queries_md5 FROM l")
def fu22(spark, sf_dir):
    """What is searched for without a planner."""
    out = P.fallback_queries(prompts(spark, sf_dir), A.expanded_query)
    return out.select("qid", F.md5(F.array_join("queries", "\n")).alias("queries_md5"))
