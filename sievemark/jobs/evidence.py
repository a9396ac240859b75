"""Queries on evidence: filters by modality, section and scope, support, coverage, rescue, selection, verified facts.

Tasks are the two companies of a question with its metric; rows of evidence are those of cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X
from ..operators import evidence as E
from ..operators import fusion
from .cases import EV_SQL, Q_SQL, evidence, questions
from .base import query, table
from .texts import TOK

#: A task of each company of a question; a third asks for an item, a half for text or tables.
_TASK = {
    "item_": "CASE qid % 3 WHEN 1 THEN 'Item 7' WHEN 2 THEN 'Item 8' ELSE '' END",
    "modality_": "CASE qid % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'text' ELSE 'hybrid' END",
}
TASK_SQL = f"{Q_SQL}, t AS (SELECT qid, CAST(task_pos AS INT) AS task_pos, task, metric AS asked, {_TASK['item_']} AS asked_item, {_TASK['modality_']} AS asked_modality FROM (SELECT *, 1 AS task_pos, company AS task FROM q UNION ALL SELECT *, 2, other FROM q))"
#: Rows of a task: evidence of its company; a row is direct if it states the task's metric and is of its item.
MATCH_SQL = f"{EV_SQL}, {TASK_SQL}, m AS (SELECT t.*, ev.ref, ev.pos, ev.company, ev.item, ev.modality, ev.metric, ev.score, ev.content, length(ev.content) AS length, CASE WHEN asked_item <> '' AND asked_item <> ev.item THEN 'IRRELEVANT' WHEN asked = ev.metric THEN 'DIRECT' ELSE 'SCOPE_ONLY' END AS support FROM t JOIN ev ON t.qid = ev.qid AND t.task = ev.company)"


def tasks(spark, sf_dir) -> DataFrame:
    q = questions(spark, sf_dir)
    pairs = F.posexplode(F.array("company", "other")).alias("task_pos", "task")
    return q.select("qid", F.col("metric").alias("asked"), F.expr(_TASK["item_"]).alias("asked_item"), F.expr(_TASK["modality_"]).alias("asked_modality"), pairs).withColumn("task_pos", F.col("task_pos") + 1)


def matches(spark, sf_dir) -> DataFrame:
    ev = evidence(spark, sf_dir).select("qid", "ref", "pos", "company", "item", "modality", "metric", "score", "content", F.length("content").alias("length"))
    j = tasks(spark, sf_dir).join(ev.withColumn("task", F.col("company")), ["qid", "task"])
    kind = E.support(F.col("company"), F.lit(""), F.col("item"), (F.col("task"), F.lit(""), F.col("asked_item")), F.col("asked"), F.col("content"))
    return j.withColumn("support", kind)


#: Names by which a question may call a company.
ALIASES = [("acme corporation", "ACME"), ("bolt motors", "BOLT"), ("cyan", "CYAN")]


@query("fl03_inferred_filters", f"WITH {EV_SQL}, {Q_SQL}, f AS (SELECT DISTINCT source_file, company FROM ev), i AS (SELECT qid, CASE WHEN contains(lower(question), 'cyan') THEN 'CYAN' ELSE coalesce((SELECT arg_min(w, p) FROM (SELECT unnest(string_split_regex(question, '[^A-Za-z0-9-]+')) AS w, generate_subscripts(string_split_regex(question, '[^A-Za-z0-9-]+'), 1) AS p) WHERE upper(w) IN ('ACME', 'BOLT', 'CYAN', 'DUNE', 'ECHO')), '') END AS company, regexp_extract(question, '20[0-9][0-9]') AS year FROM q) SELECT qid, upper(i.company) AS company, year, coalesce(f.source_file, '') AS source_file FROM i LEFT JOIN f ON f.source_file = upper(i.company) || '_' || year || '.html'")
def fl03(spark, sf_dir):
    """Company, year and file that a question's words ask for: an alias, else the first word that is a known company; the
    first year; the file of both if there is one."""
    files = evidence(spark, sf_dir).select("company", "source_file").distinct()
    known = files.select("company").distinct()
    q = questions(spark, sf_dir).select("qid", F.lower("question").alias("low"), F.posexplode(F.split("question", "[^A-Za-z0-9-]+")).alias("p", "w"), F.regexp_extract("question", X.FISCAL_YEAR, 0).alias("year"))
    word = q.join(F.broadcast(known), F.upper("w") == F.col("company"), "left")
    alias = None
    for name, ticker in ALIASES:
        alias = F.when(F.col("low").contains(name), ticker) if alias is None else alias.when(F.col("low").contains(name), ticker)
    i = word.groupBy("qid", "year").agg(F.coalesce(F.first(alias), F.min_by("company", F.when(F.col("company").isNotNull(), F.col("p"))), F.lit("")).alias("company"))
    wanted = F.concat("company", F.lit("_"), "year", F.lit(".html"))
    return i.withColumn("source_file", wanted).join(files.select("source_file", F.lit(True).alias("has")), "source_file", "left").select("qid", "company", "year", F.when(F.col("has"), F.col("source_file")).otherwise("").alias("source_file"))


@query("fl05_modality", f"WITH {MATCH_SQL} SELECT qid, task_pos, ref, CAST(CASE WHEN asked_modality = 'text' AND modality <> 'text' THEN 1 ELSE 0 END AS INT) AS preference FROM m WHERE asked_modality <> 'table' OR modality = 'table'")
def fl05(spark, sf_dir):
    keep, rank = E.soft_modality(F.col("asked_modality"), F.col("modality"))
    return matches(spark, sf_dir).where(keep).select("qid", "task_pos", "ref", rank.cast("int").alias("preference"))


@query("fl06_section", f"WITH {MATCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, task_pos ORDER BY pos) AS n FROM m), x AS (SELECT *, CASE WHEN asked_item = '' THEN 0 WHEN item = asked_item THEN 1 END AS tier FROM r WHERE n <= 2 UNION ALL SELECT *, 2 FROM r WHERE asked_item <> '' AND item = asked_item UNION ALL SELECT *, 3 FROM r WHERE asked_item <> '' AND modality = 'text'), b AS (SELECT *, min(tier) OVER (PARTITION BY qid, task_pos) AS best FROM x WHERE tier IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY qid, task_pos ORDER BY length, pos) AS k FROM b WHERE tier = best) SELECT qid, task_pos, ref, CAST(tier AS INT) AS tier FROM k WHERE tier < 3 OR k = 1")
def fl06(spark, sf_dir):
    m = matches(spark, sf_dir).withColumn("query", F.struct("qid", "task_pos"))
    first = m.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).where("_n <= 2").drop("_n")
    out = E.enforce_section(first, m, qid="query")
    return out.select("qid", "task_pos", "ref", F.col("tier").cast("int").alias("tier"))


@query("fl07_cross_section", f"WITH {MATCH_SQL}, h AS (SELECT qid, list(DISTINCT asked_item) FILTER (WHERE asked_item <> '') AS items FROM t GROUP BY qid) SELECT DISTINCT ev.qid, ev.ref FROM ev JOIN h USING (qid) LEFT JOIN t ON t.qid = ev.qid AND t.task = ev.company WHERE items IS NULL OR len(items) = 0 OR CASE WHEN t.task IS NULL THEN list_contains(items, ev.item) ELSE t.asked_item = '' OR t.asked_item = ev.item END")
def fl07(spark, sf_dir):
    """Evidence without rows of sections that no task of theirs asks for; rows of no task need an item that some task asks
    for. Questions whose tasks ask for no item keep all."""
    t = tasks(spark, sf_dir).select("qid", F.col("task").alias("company"), "asked_item")
    hard = t.groupBy("qid").agg(F.collect_set(F.when(F.col("asked_item") != "", F.col("asked_item"))).alias("items"))
    j = evidence(spark, sf_dir).select("qid", "ref", "company", "item").join(hard, "qid").join(t, ["qid", "company"], "left")
    fits = F.when(F.col("asked_item").isNull(), F.array_contains("items", F.col("item"))).otherwise((F.col("asked_item") == "") | (F.col("asked_item") == F.col("item")))
    return j.where((F.size("items") == 0) | fits).select("qid", "ref").distinct()


@query("fl09_support", f"WITH {MATCH_SQL} SELECT qid, task_pos, ref, support FROM m")
def fl09(spark, sf_dir):
    return matches(spark, sf_dir).select("qid", "task_pos", "ref", "support")


@query("fl10_direct_value", f"WITH {EV_SQL} SELECT qid, ref, metric = 'Net sales' AS sales, metric = 'Net income' AND modality = 'text' AND prior > 25 AS income_told FROM ev")
def fl10(spark, sf_dir):
    """Whether a row states its metric's value: rows of tables and sentences; a sentence with no number but a year isn't one."""
    ev = evidence(spark, sf_dir)
    told = F.when(F.col("prior") > 25, F.col("content")).otherwise(F.concat("company", F.lit(" speaks of net income for fiscal 2023 in Item 7. It grew 5%.")))
    return ev.select("qid", "ref", A.direct_value(F.lit("revenue"), F.col("content")).alias("sales"), ((F.col("modality") == "text") & A.direct_value(F.lit("net earnings"), told)).alias("income_told"))


_AUDIT = "concat(CASE WHEN l_partkey % 2 = 0 THEN 'Report of Independent Registered Public Accounting Firm. ' ELSE '' END, CASE WHEN l_partkey % 3 = 0 THEN 'Opinion on the Financial  Statements. ' ELSE '' END, CASE WHEN l_partkey % 5 = 0 THEN 'In our opinion they present fairly the position. ' ELSE '' END, CASE WHEN l_partkey % 7 = 0 THEN 'We conducted our audits under the standards of the PCAOB. ' ELSE '' END, CASE WHEN l_partkey % 11 = 0 THEN 'They are required to be independent.' ELSE '' END)"


@query("fu17_audit_score", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN l_partkey % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN l_partkey % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS score FROM lineitem")
def fu17(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", E.audit_score(F.expr(_AUDIT)).cast("int").alias("score"))


_RERANKED = "CASE WHEN qid % 10 = 0 THEN NULL ELSE CAST(score AS DOUBLE) END"


@query("fu07_degraded_rerank", f"WITH {EV_SQL} SELECT qid, ref, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_RERANKED} DESC NULLS LAST, pos) AS BIGINT) AS rank, CASE WHEN qid % 10 = 0 THEN 'rerank_failed' ELSE '' END AS warning FROM ev")
def fu07(spark, sf_dir):
    """Reranked rows; a query whose model gave nothing keeps its order and gets a warning."""
    ev = evidence(spark, sf_dir).select("qid", "ref", F.col("pos").alias("rank"), "score")
    scores = ev.where("qid % 10 <> 0").select("qid", "ref", F.col("score").cast("double").alias("rerank_score"))
    return fusion.rerank_or_keep(ev.drop("score"), scores, key="ref").select("qid", "ref", F.col("rank").cast("long").alias("rank"), "warning")


@query("fu15_rescue", f"WITH {MATCH_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY qid, task_pos ORDER BY score DESC, pos) AS n FROM m), k AS (SELECT * FROM s WHERE n <= 1), u AS (SELECT qid, task_pos FROM t EXCEPT SELECT qid, task_pos FROM k WHERE support = 'DIRECT'), r AS (SELECT s.*, row_number() OVER (PARTITION BY s.qid, s.task_pos ORDER BY score DESC, pos) AS r FROM s JOIN u ON s.qid = u.qid AND s.task_pos = u.task_pos WHERE support = 'DIRECT') SELECT qid, task_pos, ref, false AS rescued FROM k UNION ALL SELECT qid, task_pos, ref, true FROM r WHERE r = 1")
def fu15(spark, sf_dir):
    m = matches(spark, sf_dir)
    first = m.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "task_pos").orderBy(F.desc("score"), "pos"))).where("_n = 1").drop("_n")
    return E.rescue(tasks(spark, sf_dir), first, m, ["qid", "task_pos"]).select("qid", "task_pos", "ref", "rescued")


@query("fu16_select_evidence", f"WITH {MATCH_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY qid, task_pos ORDER BY pos) AS turn FROM m WHERE support <> 'IRRELEVANT'), p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, ref ORDER BY turn, task_pos) = 1 THEN 1 ELSE 0 END AS new FROM a WHERE turn <= 2), h AS (SELECT *, sum(new) OVER (PARTITION BY qid ORDER BY turn, task_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM p) SELECT qid, ref, array_to_string(list_sort(list_distinct(list(task))), ',') AS tasks FROM h WHERE held - new < 3 GROUP BY qid, ref")
def fu16(spark, sf_dir):
    m = matches(spark, sf_dir).where("support <> 'IRRELEVANT'")
    return E.select_evidence(m.select("qid", "task", "task_pos", "ref", "pos"), 3, 2).withColumn("tasks", F.array_join("tasks", ","))


@query("fu18_coverage_warnings", f"WITH {MATCH_SQL}, d AS (SELECT DISTINCT qid, task_pos FROM m WHERE support = 'DIRECT'), s AS (SELECT DISTINCT qid, task_pos FROM m WHERE item = asked_item) SELECT qid, array_to_string(list_sort(list(w)), '; ') AS warnings, 'DEGRADED' AS status FROM (SELECT qid, 'missing_direct_support: ' || task || ' | metric=' || asked AS w FROM t WHERE (qid, task_pos) NOT IN (SELECT (qid, task_pos) FROM d) UNION ALL SELECT qid, 'missing_scoped_coverage: ' || task || ' | ' || asked_item FROM t WHERE asked_item <> '' AND (qid, task_pos) NOT IN (SELECT (qid, task_pos) FROM s)) GROUP BY qid")
def fu18(spark, sf_dir):
    """What a query's evidence lacks: direct support of a task's metric, or its section; queries that lack nothing have no row."""
    m, t = matches(spark, sf_dir), tasks(spark, sf_dir)
    direct = E.uncovered(t, m, ["qid", "task_pos"]).select("qid", F.concat(F.lit("missing_direct_support: "), "task", F.lit(" | metric="), "asked").alias("w"))
    scoped = t.where("asked_item <> ''").join(m.where("item = asked_item").select("qid", "task_pos").distinct(), ["qid", "task_pos"], "left_anti")
    scoped = scoped.select("qid", F.concat(F.lit("missing_scoped_coverage: "), "task", F.lit(" | "), "asked_item").alias("w"))
    return direct.unionByName(scoped).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("w")), "; ").alias("warnings"), F.lit("DEGRADED").alias("status"))


@query("fu20_extraction_subset", f"WITH {MATCH_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY qid, task ORDER BY pos) AS n FROM m), r AS (SELECT qid, ref, min(CASE WHEN n <= 2 AND task_pos = 2 THEN 0 WHEN n <= 2 THEN 1 ELSE 2 END * 1000000 + CASE WHEN n <= 2 THEN task_pos ELSE 0 END * 10000 + pos) AS place FROM n GROUP BY qid, ref) SELECT qid, ref, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM r) WHERE rank <= 4")
def fu20(spark, sf_dir):
    m = matches(spark, sf_dir).withColumn("priority", F.col("task_pos") == 2)
    return E.extraction_subset(m, 4).withColumn("rank", F.col("rank").cast("long"))


def claims(spark, sf_dir) -> DataFrame:
    """What a model might extract: a claim for each row of evidence, four sixths of them with a fault."""
    ev = evidence(spark, sf_dir)
    fault = F.col("fault")
    quote = F.when(F.col("modality") == "table", F.concat(F.lit("| "), "metric", F.lit(" | "), F.col("amount").cast("string"), F.lit(" | "), F.col("prior").cast("string"), F.lit(" |"))).otherwise(F.concat("company", F.lit(" reported  "), F.lower("metric"), F.lit(" of $"), F.col("amount").cast("string"), F.lit(" "), "scale"))
    return ev.select(
        "qid", "pos", F.when(fault == 1, "E99").otherwise(F.col("ref")).alias("ref"), F.when(fault == 2, "Total liabilities").otherwise(F.col("metric")).alias("metric"),
        F.when(fault == 3, "$ 999,999,999.00").otherwise(F.concat(F.lit("$"), F.col("amount").cast("string"))).alias("raw_value"),
        F.when(fault == 4, F.concat(quote, F.lit(" and more"))).otherwise(quote).alias("quote"), F.when(F.col("pos") % 2 == 0, "").otherwise(F.lower("company")).alias("company"), F.lit("").alias("fiscal_year"), F.lit("unit").alias("scale"),
    )


@query("lg01_verified_facts", f"WITH {EV_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY qid, metric, amount, company, fiscal_year ORDER BY pos) AS n FROM ev WHERE fault IN (0, 5)) SELECT qid, ref, upper(company) AS company, CAST(fiscal_year AS VARCHAR) AS fiscal_year, metric, CAST(amount AS DOUBLE) AS value, scale, 'F' || CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) AS VARCHAR) AS fact_id FROM k WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos) <= 40")
def lg01(spark, sf_dir):
    f = E.verified_facts(claims(spark, sf_dir), evidence(spark, sf_dir))
    return f.select("qid", "ref", F.upper("company").alias("company"), "fiscal_year", "metric", F.col("value").cast("double").alias("value"), "scale", "fact_id")


_FACTS_SQL = "f AS (SELECT qid, pos, metric, fiscal_year, amount, scale, amount * CASE scale WHEN 'billion' THEN 1000000000 WHEN 'million' THEN 1000000 WHEN 'thousand' THEN 1000 ELSE 1 END AS base FROM ev)"


@query("lg05_premise", f"WITH {EV_SQL}, {_FACTS_SQL}, p AS (SELECT qid, min(fiscal_year) AS y, CAST(min(base) FILTER (WHERE metric = 'Net income') AS DECIMAL(30,2)) AS b FROM f WHERE qid % 2 = 0 GROUP BY qid HAVING b IS NOT NULL), s AS (SELECT qid, y, b * CASE WHEN qid % 4 = 0 THEN 1.05 ELSE 1.5 END AS stated FROM p), g AS (SELECT f.qid, min(abs(CAST(base AS DOUBLE) - CAST(stated AS DOUBLE))) AS gap FROM f JOIN s ON f.qid = s.qid AND f.fiscal_year = s.y WHERE metric = 'Net income' GROUP BY f.qid) SELECT f.qid, f.pos FROM f LEFT JOIN s USING (qid) LEFT JOIN g USING (qid) WHERE stated IS NULL OR metric <> 'Net income' OR coalesce(gap <= 0.08 * CAST(stated AS DOUBLE), false)")
def lg05(spark, sf_dir):
    """Half of the questions take a net income for granted that is 5 % or 50 % more than the least that the facts have."""
    ev = evidence(spark, sf_dir)
    facts = ev.select("qid", "pos", "metric", "fiscal_year", F.col("amount").alias("value"), "scale")
    base = F.col("amount") * X.scale_factor(F.col("scale"))
    p = ev.where("qid % 2 = 0").groupBy("qid").agg(F.min("fiscal_year").cast("string").alias("year"), F.min(F.when(F.col("metric") == "Net income", base)).cast("decimal(30,2)").alias("b")).where("b is not null")
    premises = p.select("qid", "year", (F.col("b") * F.when(F.col("qid") % 4 == 0, F.lit("1.05").cast("decimal(4,2)")).otherwise(F.lit("1.50").cast("decimal(4,2)"))).alias("stated"))
    return E.premise_consistent(facts, premises).select("qid", "pos")


@query("lg06_scales", f"WITH {EV_SQL} SELECT qid, ref, scale, CASE WHEN modality = 'table' AND fault = 3 THEN 'unit' WHEN modality = 'table' THEN scale WHEN fault = 2 THEN 'thousand' WHEN fault = 1 THEN 'billion' ELSE 'unit' END AS found FROM ev")
def lg06(spark, sf_dir):
    """The scale beside a number, in a table's header, in the value or as proposed, by what a row offers."""
    ev = evidence(spark, sf_dir)
    table_, fault = F.col("modality") == "table", F.col("fault")
    quote = F.when(table_, F.concat(F.lit("| "), "metric", F.lit(" | "), F.col("amount").cast("string"), F.lit(" |"))).otherwise(F.concat(F.lit("it was $"), F.col("amount").cast("string"), F.lit(", they said")))
    content = F.when(fault == 3, F.concat(F.lit("Table header: x | in millions, except per share"), F.lit("\n"), "content")).otherwise(F.col("content"))
    metric = F.when(fault == 3, "Earnings per share").otherwise(F.col("metric"))
    raw = F.when((fault == 2) & ~table_, F.concat(F.col("amount").cast("string"), F.lit(" Thousands"))).otherwise(F.col("amount").cast("string"))
    given = F.when(fault == 1, " Billions").otherwise("other")
    beside = A.scale_of_fact(F.concat(F.lit("$"), F.col("amount").cast("string"), F.lit("0")), F.lit(""), F.col("metric"), F.concat(F.lit("about "), F.col("amount").cast("string"), F.lit(" "), "scale", F.lit("s in all")), F.col("content"))
    return ev.select("qid", "ref", beside.alias("scale"), A.scale_of_fact(raw, given, metric, quote, content).alias("found"))


@query("tx20_canonical_item", f"WITH {EV_SQL} SELECT qid, ref, CASE WHEN fault = 0 THEN 'Item 8' WHEN modality = 'table' THEN item WHEN fault = 1 THEN 'Item 7' WHEN fault = 2 THEN 'Item 9B' ELSE item END AS item FROM ev")
def tx20(spark, sf_dir):
    """The item of a row: an auditor's report is Item 8; tables keep their label; an introduction of management's
    discussion is Item 7; else the item that the opening names, else the label."""
    ev, fault = evidence(spark, sf_dir), F.col("fault")
    opening = (
        F.when(fault == 0, "Report of Independent Registered  Public Accounting Firm: opinion on the financial statements. ")
        .when(fault == 1, "Management's Discussion and Analysis. ").when(fault == 2, "See item 9b here. ").otherwise("")
    )
    content = F.concat(opening, F.regexp_replace("content", r" See Item \w+\.", ""))
    label = F.when(fault == 1, F.when(F.col("modality") == "table", F.col("item")).otherwise("")).otherwise(F.col("item"))
    return ev.select("qid", "ref", X.canonical_item(label, F.col("modality"), content).alias("item"))


_ANCHORS = f"w AS (SELECT doc_id, trim(text) AS t, lower(trim(text)) AS low, {TOK.format('right(text, 200)')} AS ws FROM documents), a AS (SELECT *, list_filter(ws, lambda x, i: length(x) >= 5 AND contains(low, x) AND NOT list_contains(ws[1:i-1], x)) AS fs FROM w), b AS (SELECT *, coalesce(list_filter(fs, lambda x: length(x) = list_max(list_transform(fs, lambda y: length(y))))[1], '') AS anchor FROM a), s AS (SELECT *, least(greatest(0, greatest(0, strpos(low, anchor) - 1) - 133), length(t) - 400) AS s0 FROM b)"
_WINDOWS = "e AS (SELECT doc_id, t, s0 - length(regexp_extract(left(t, s0), '\\S*$')) AS s1, s0 + 400 AS e0 FROM s WHERE length(t) > 400), x AS (SELECT doc_id, CASE WHEN s1 > 0 THEN '... ' ELSE '' END || trim(CASE WHEN e0 < length(t) THEN regexp_replace(substr(t, s1 + 1, e0 - s1), '\\S+$', '') ELSE substr(t, s1 + 1) END) || CASE WHEN e0 < length(t) THEN ' ...' ELSE '' END AS v FROM e)".replace("\\\\", "\\")


@query("tx21_centred_window", f"WITH {_ANCHORS}, {_WINDOWS} SELECT doc_id, md5(t) AS window_md5 FROM s WHERE length(t) <= 400 UNION ALL SELECT doc_id, md5(CASE WHEN length(v) <= 400 THEN v ELSE rtrim(left(v, 396)) || ' ...' END) FROM x")
def tx21(spark, sf_dir):
    """A window of 400 characters of each document around the longest word that its first lines share with it."""
    docs = table(spark, sf_dir, "documents")
    asked = F.substring("text", -200, 200)
    return docs.select("doc_id", F.md5(X.centred_window(F.col("text"), asked, 400)).alias("window_md5"))


@query("tx22_header_only", f"WITH {EV_SQL} SELECT qid, ref, CASE WHEN modality = 'table' THEN concat('Table header: ', metric, ' | FY', CAST(fiscal_year AS VARCHAR), ' | in ', scale, 's') ELSE '' END AS header, CASE WHEN modality = 'table' THEN concat('| ', metric, ' | ', CAST(amount AS VARCHAR), ' | ', CAST(prior AS VARCHAR), ' |') ELSE '' END AS rows FROM ev")
def tx22(spark, sf_dir):
    """A row of evidence cut to its table's header, and to the rows of its metric."""
    ev = evidence(spark, sf_dir)
    extra = F.concat("content", F.lit("\n| Other income | 7 |"))
    return ev.select("qid", "ref", X.header_lines(F.col("content")).alias("header"), X.metric_rows(extra, F.col("metric")).alias("rows"))


_NAMES = [a for a, _ in X.COMPANY_ALIASES] + ["nobody", "Applet of Meta"]
_ALIASED = "concat('What did ', element_at(array(" + ", ".join(f"'{n}'" for n in _NAMES) + "), CAST(1 + qid % 32 AS INT)), ' and ', company, ' earn?')"
_ALIASED_SQL = "concat('What did ', [" + ", ".join(f"'{n}'" for n in _NAMES) + "][1 + CAST(qid % 32 AS INT)], ' and ', company, ' earn?')"


@query("fl03_aliases", f"WITH {Q_SQL}, v AS (SELECT qid, {_ALIASED_SQL} AS t FROM q), a AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{a}{chr(39)}, {chr(39)}{t}{chr(39)})' for i, (a, t) in enumerate(X.COMPANY_ALIASES))}) x(i, a, t)) SELECT qid, coalesce(arg_min(a.t, i), '') AS ticker FROM v LEFT JOIN a ON contains(lower(v.t), a) GROUP BY qid")
def fl03_aliases(spark, sf_dir):
    """The company that a question calls by one of its names."""
    from ..operators.filters import called_company

    return questions(spark, sf_dir).select("qid", called_company(F.expr(_ALIASED)).alias("ticker"))


#: What rows of evidence say for the kinds, by parts that the row's numbers choose.
_KINDS = (
    "concat(CASE WHEN l_partkey % 3 = 0 THEN 'Revenues by Region are below.' WHEN l_partkey % 3 = 1 THEN repeat('x ', 460) ELSE 'Asia-Pacific and more. ' END, CASE WHEN l_suppkey % 2 = 0 THEN concat(chr(10), chr(10), 'Table: | Europe | 1 |', CASE WHEN l_suppkey % 4 = 0 THEN ' | Total Revenues | 5 |' ELSE '' END) ELSE ' none' END, "
    "CASE WHEN l_partkey % 5 = 0 THEN ' In our opinion they present  fairly; we maintained effective internal control over financial reporting.' WHEN l_partkey % 5 = 1 THEN ' Opinion on the financial statements. PCAOB: a public accounting firm.' WHEN l_partkey % 5 = 2 THEN ' It is the Auditor responsibility. They are required to be independent.' ELSE '' END, "
    "CASE WHEN l_suppkey % 3 = 0 THEN ' Guarantees and indemnification. ' ELSE ' ' END, CASE WHEN l_suppkey % 5 = 0 THEN 'Executive Officers: Jane Doe (aged 61)' WHEN l_suppkey % 5 = 1 THEN 'Tim Cook, 17; Mary Major - 44' ELSE 'Jane Doe' END)"
)
_TASKS = "CASE l_linenumber % 4 WHEN 0 THEN 'Auditor Independence and responsibility' WHEN 1 THEN 'auditor  independence' WHEN 2 THEN 'Audit opinion' ELSE 'report' END"
_WHO = "CASE l_linenumber % 3 WHEN 0 THEN 'What age has Jane Doe?' WHEN 1 THEN 'Which executive officers are there?' ELSE 'Who is Mary Major' END"
_LOW = "trim(regexp_replace(lower(c), '\\s+', ' ', 'g'))".replace("\\\\", "\\")
_TOLD = r"(?is)\b{0}\b\s*[,;(\-]?\s*(?:age[d]?\s*)?(1[89]|[2-9]\d)\b"


@query("fl11_evidence_kinds", rf"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_KINDS} AS c, {_TASKS} AS d, {_WHO} AS w FROM lineitem), u AS (SELECT *, lower(c) AS lc, {_LOW} AS low, strpos(lower(c), chr(10) || chr(10) || 'table:') AS tb FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tb > 0 AND regexp_matches(substr(lc, greatest(1, tb - 900), least(900, tb - 1)), 'by region|asia-pacific') AND NOT contains(substr(lc, tb, 4500), '| total revenues |') AS regional, regexp_matches(low, 'guarantee|indemnif') AS guarantee,
CASE l_linenumber % 4 WHEN 0 THEN (contains(low, 'required to be independent') OR (contains(low, 'public accounting firm') AND contains(low, 'pcaob'))) AND contains(low, 'auditor responsibility') WHEN 1 THEN contains(low, 'required to be independent') OR (contains(low, 'public accounting firm') AND contains(low, 'pcaob')) WHEN 2 THEN contains(low, 'present fairly') AND contains(low, 'maintained effective internal control') ELSE contains(low, 'opinion on the financial') OR contains(low, 'present fairly') END AS audit,
CASE l_linenumber % 3 WHEN 0 THEN regexp_matches(c, '{_TOLD.format("Jane Doe")}') WHEN 1 THEN contains(lc, 'executive officer') AND regexp_matches(c, '{_TOLD.format("[A-Z][a-z]{2,}" + chr(92) + "s+[A-Z][a-z]{2,}")}') ELSE regexp_matches(c, '{_TOLD.format("Mary Major")}') END AS biography FROM u""")
def fl11(spark, sf_dir):
    """Rows told to be breakdowns by region, on guarantees, what an audit task wants, and biographies."""
    from ..operators import filters

    key, c = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], F.col("c")
    rows = table(spark, sf_dir, "lineitem").select(*key, F.expr(_KINDS).alias("c"), F.expr(_TASKS).alias("d"), F.expr(_WHO).alias("w"))
    return rows.select(*key, filters.regional_breakdown(c).alias("regional"), filters.guarantee(c).alias("guarantee"), filters.audit_evidence(F.col("d"), c).alias("audit"), filters.biography(F.col("w"), c).alias("biography"))
