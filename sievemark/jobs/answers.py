"""Queries on answers: bodies, numbers, expected documents and sections, coverage, audit, judge results, rescoring.

Questions and evidence are those of cases. What no SQL can say (the greedy match of numbers) is tested by brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X
from ..operators import audit, evaluate
from ..operators import evidence as E
from .cases import EV_SQL, Q_SQL, evidence, questions
from .base import query, table

_MAIN = f"regexp_replace(replace(replace(replace(replace(replace(replace(coalesce({{0}}, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '{A.SOURCES.replace('{', '{{').replace('}', '}}')}', '')"
_BODY = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MAIN}, '{A.REFERENCE_MARK}', ' ', 'g'), '{A.BARE_REFERENCE}', ' ', 'g'), '[`*_>#|]', ' ', 'g'), '\\s+', ' ', 'g'))"
_BARE = f"regexp_replace(regexp_replace({_BODY}, '{A.CALENDAR_DATE.replace('{', '{{').replace('}', '}}')}', '', 'g'), '{A.FILING_IDENTIFIER.replace('{', '{{').replace('}', '}}')}', '', 'g')"
_COUNTS = "list_transform(regexp_extract_all({0}, '" + A.COUNT_OF_YEARS + "', 1), lambda w: {{'v': CAST(list_position([" + ", ".join(f"'{w}'" for w in A.COUNT_WORDS) + "], lower(w)) AS DOUBLE), 'p': false}})"
#: Numbers of an answer in SQL, each once, in no order: {0} is the answer.
NUMBERS_SQL = "list_distinct(list_concat(" + _COUNTS.replace("{0}", _BODY) + ", list_transform(regexp_extract_all(" + _BARE + ", '" + A.NUMBER + "'), lambda x: {{'v': CAST(regexp_replace(x, '[,%]', '', 'g') AS DOUBLE), 'p': ends_with(x, '%')}})))"


@query("tx09_answer_body", f"WITH {Q_SQL} SELECT qid, md5({_BODY.format('predicted')}) AS body_md5, md5({_BODY.format('expected')}) AS expected_md5 FROM q")
def tx09(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", F.md5(A.answer_body(F.col("predicted"))).alias("body_md5"), F.md5(A.answer_body(F.col("expected"))).alias("expected_md5"))


@query("ev03_numbers", f"WITH {Q_SQL}, n AS (SELECT qid, {NUMBERS_SQL.format('predicted')} AS n FROM q) SELECT qid, CAST(len(n) AS BIGINT) AS numbers, CAST(len(list_filter(n, lambda x: x.p)) AS BIGINT) AS percentages, round(coalesce(list_sum(list_transform(n, lambda x: x.v)), 0), 4) AS total FROM n")
def ev03(spark, sf_dir):
    n = questions(spark, sf_dir).select("qid", A.answer_numbers(F.col("predicted")).alias("n"))
    return n.select("qid", F.size("n").cast("long").alias("numbers"), F.size(F.filter("n", lambda x: x["percent"])).cast("long").alias("percentages"), F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x["value"]), 4).alias("total"))


@query("ev04_numeric_scores")
def ev04(spark, sf_dir):
    n = questions(spark, sf_dir).select("qid", A.answer_numbers(F.col("expected")).alias("e"), A.answer_numbers(F.col("predicted")).alias("p"))
    return n.select("qid", A.numeric_scores(F.col("e"), F.col("p")).alias("s")).select("qid", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


def fact_values(spark, sf_dir) -> DataFrame:
    """(qid, stated): the numbers of each question's facts, with those in the neighbouring scale."""
    ev = evidence(spark, sf_dir).where("fault < 4")
    value = F.col("amount").cast("double")
    shifted = F.when(F.col("scale") == "million", value / 1000).when(F.col("scale") == "billion", value * 1000)
    each = ev.select("qid", F.explode(F.array_compact(F.array(value, shifted))).alias("v"))
    return each.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct(F.col("v").alias("value"), F.lit(False).alias("percent")))).alias("stated"))


@query("ev05_fact_value_recall")
def ev05(spark, sf_dir):
    """Share of the expected answer's numbers that the facts have, as they are or in the neighbouring scale; null where
    nothing is expected or there are no facts."""
    q = questions(spark, sf_dir).select("qid", A.answer_numbers(F.col("expected")).alias("e"))
    return q.join(fact_values(spark, sf_dir), "qid", "left").select("qid", F.round(A.numeric_scores(F.col("e"), F.col("stated"))["recall"], 6).alias("recall"))


@query("ev06_calculation_match")
def ev06(spark, sf_dir):
    """Whether a difference, change or sum of a question's two prices is borne out by question and answer."""
    q = questions(spark, sf_dir)
    price, pct = F.col("price").cast("double"), F.col("pct").cast("double")
    kind = F.when(F.col("qid") % 3 == 0, "difference").when(F.col("qid") % 3 == 1, "percentage_change").otherwise("sum")
    value = F.when(kind == "difference", price - pct).when(kind == "percentage_change", pct + 0.5).otherwise(price * 2)
    result = F.array(F.struct(F.round(value, 2).alias("value"), (kind == "percentage_change").alias("percent")))
    expected = F.concat(F.col("expected"), F.lit(" Before it was "), F.col("pct"), F.lit(" million."))
    return q.select("qid", kind.alias("kind"), E.calculation_match(F.col("question"), expected, kind, result).alias("matched"))


_NEAR = r"""(regexp_matches(t, {p}) AND len(list_filter(cs, lambda o: o <> c AND regexp_matches(regexp_extract(t, {p}, 1), '(?i)\b' || o || '\b'))) = 0)"""
_FORWARD = _NEAR.format(p=r"('(?is)\b' || c || '\b(.{0,80}?)\b(?:FY\s*)?' || y || '\b')")
_BACKWARD = _NEAR.format(p=r"('(?is)\b(?:FY\s*)?' || y || '\b(.{0,80}?)\b' || c || '\b')")
DOCS_SQL = f"""x1 AS (SELECT DISTINCT question AS t, [company, other] AS cs, [y1, y2] AS ys FROM q), x2 AS (SELECT *, unnest(cs) AS c FROM x1), x3 AS (SELECT *, unnest(ys) AS y FROM x2),
x4 AS (SELECT *, {_FORWARD} AS fw, {_BACKWARD} AS bw FROM x3), x5 AS (SELECT *, bool_or(fw) OVER (PARTITION BY t, c) AS led FROM x4), x6 AS (SELECT *, fw OR (NOT led AND bw) AS pair FROM x5), x7 AS (SELECT *, bool_or(pair) OVER (PARTITION BY t) AS anyp FROM x6),
docs AS (SELECT DISTINCT qid, c || '_' || y || '.html' AS source_file FROM x7 JOIN q ON t = question WHERE NOT anyp OR pair)"""


def documents_of(spark, sf_dir) -> DataFrame:
    q = questions(spark, sf_dir).select("qid", F.col("question").alias("text"), F.array("company", "other").alias("companies"), F.array("y1", "y2").alias("years"))
    return E.expected_documents(q)


@query("ev07_expected_documents", f"WITH {Q_SQL}, {DOCS_SQL} SELECT qid, source_file FROM docs")
def ev07(spark, sf_dir):
    return documents_of(spark, sf_dir)


_ITEM = r"CASE WHEN coalesce(regexp_extract({0}, '(?i)\bitem\s+(\d+[a-z]?)\b', 1), '') = '' THEN '' ELSE 'item ' || lower(regexp_extract({0}, '(?i)\bitem\s+(\d+[a-z]?)\b', 1)) END"


@query("ev10_expected_sections", rf"""WITH {Q_SQL}, {DOCS_SQL}, d AS (SELECT *, regexp_extract(source_file, '^(.*)_', 1) AS company FROM docs), p AS (SELECT qid, unnest(regexp_split_to_array(section, '[;；]')) AS part FROM q),
o AS (SELECT qid, upper(regexp_extract(part, '^\s*([A-Za-z][A-Za-z0-9._-]*)\s*[:：]', 1)) AS company, {_ITEM.format('part')} AS s FROM p), n AS (SELECT o.qid, source_file, s FROM o JOIN d ON o.qid = d.qid AND o.company = d.company WHERE o.company <> ''),
g AS (SELECT qid, CASE WHEN a <> '' THEN a ELSE b END AS s FROM (SELECT qid, {_ITEM.format('section')} AS a, {_ITEM.format('question')} AS b FROM q WHERE qid NOT IN (SELECT qid FROM n)))
SELECT DISTINCT qid, source_file, s AS section FROM n WHERE s <> '' UNION SELECT g.qid, source_file, s FROM g JOIN d USING (qid) WHERE s <> ''""")
def ev10(spark, sf_dir):
    return E.expected_sections(questions(spark, sf_dir).select("qid", "section", "question"), documents_of(spark, sf_dir))


@query("ev11_task_coverage", rf"""WITH {EV_SQL}, {Q_SQL}, t AS (SELECT qid, unnest([company, other]) AS company, metric, predicted FROM q), m AS (SELECT t.qid, t.company, ref, ev.metric = t.metric AS direct, contains(upper({_MAIN.format('predicted')}), '[' || ref || ']') AS cited FROM t JOIN ev ON t.qid = ev.qid AND t.company = ev.company),
c AS (SELECT t.qid, t.company, count(ref) > 0 AS assigned, coalesce(bool_or(direct), false) AS direct, coalesce(bool_or(direct AND cited), false) AS cited FROM (SELECT DISTINCT qid, company FROM t) t LEFT JOIN m USING (qid, company) GROUP BY ALL)
SELECT qid, count(*) AS tasks, round(avg(CAST(assigned AS INT)), 6) AS assigned, round(avg(CAST(direct AS INT)), 6) AS direct, round(avg(CAST(cited AS INT)), 6) AS cited FROM c GROUP BY qid""")
def ev11(spark, sf_dir):
    """Shares of a question's tasks that have evidence, evidence that supports them directly, and such that the body cites."""
    q = questions(spark, sf_dir)
    tasks = q.select("qid", F.explode(F.array_distinct(F.array("company", "other"))).alias("company"), F.col("metric").alias("asked"), F.upper(A.answer_main(F.col("predicted"))).alias("main"))
    m = tasks.join(evidence(spark, sf_dir).select("qid", "company", "ref", "metric"), ["qid", "company"], "left")
    direct = F.coalesce(F.col("metric") == F.col("asked"), F.lit(False))
    cited = direct & F.col("main").contains(F.concat(F.lit("["), "ref", F.lit("]")))
    each = m.groupBy("qid", "company").agg((F.count("ref") > 0).alias("assigned"), F.bool_or(direct).alias("direct"), F.coalesce(F.bool_or(cited), F.lit(False)).alias("cited"))
    return each.groupBy("qid").agg(F.count("*").alias("tasks"), *[F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in ("assigned", "direct", "cited")])


@query("ev12_scope_match", f"WITH {EV_SQL}, {Q_SQL}, {DOCS_SQL} SELECT ev.qid, count(*) AS rows, round(avg(CASE WHEN docs.qid IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS scope_match, round(avg(CASE WHEN docs.qid IS NULL THEN 1e0 ELSE 0e0 END), 6) AS contamination FROM ev LEFT JOIN docs ON ev.qid = docs.qid AND ev.source_file = docs.source_file GROUP BY ev.qid")
def ev12(spark, sf_dir):
    """Share of a question's evidence that is of a filing it asks about, and of others."""
    docs = documents_of(spark, sf_dir).withColumn("hit", F.lit(1.0))
    j = evidence(spark, sf_dir).select("qid", "source_file").join(docs, ["qid", "source_file"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    return j.groupBy("qid").agg(F.count("*").alias("rows"), F.round(F.avg("hit"), 6).alias("scope_match"), F.round(F.avg(1 - F.col("hit")), 6).alias("contamination"))


_CONFIG = """sha256('{{"k":8,"question":"' || md5(question) || '","version":"' || {0} || '"}}')"""


@query("ev19_resume", f"WITH {Q_SQL}, s AS (SELECT qid, status <> 'F' AS success, {_CONFIG.format("CASE WHEN qid % 5 = 0 THEN 'v1' ELSE 'v2' END")} AS saved, {_CONFIG.format("'v2'")} AS wanted FROM q WHERE qid % 3 <> 0) SELECT q.qid, {_CONFIG.format("'v2'")} AS signature FROM q WHERE q.qid NOT IN (SELECT qid FROM s WHERE success AND saved = wanted)")
def ev19(spark, sf_dir):
    """Questions that are still to be answered: those without a saved success whose configuration is today's.

    Saved rows are two thirds of the questions, a fifth of them by an older configuration."""
    def signature(version):
        return F.sha2(F.to_json(F.struct(F.lit(8).alias("k"), F.md5("question").alias("question"), version.alias("version"))), 256)

    q = questions(spark, sf_dir)
    now = q.select("qid", signature(F.lit("v2")).alias("signature"))
    saved = q.where("qid % 3 <> 0 and status <> 'F'").select("qid", signature(F.when(F.col("qid") % 5 == 0, "v1").otherwise("v2")).alias("signature"))
    return now.join(saved, ["qid", "signature"], "left_anti")


_REFUSED = " OR ".join(f"contains(lower(predicted), '{w}')" for w in A.REFUSALS)


@query("ev20_rescore", f"WITH {Q_SQL}, n AS (SELECT status, predicted, {NUMBERS_SQL.format('predicted')} AS n, {_BODY.format('predicted')} AS b FROM q) SELECT status AS subset, count(*) AS rows, CAST(count(*) FILTER (WHERE {_REFUSED}) AS BIGINT) AS refused, CAST(count(*) FILTER (WHERE b = '') AS BIGINT) AS blank, round(avg(len(n)), 6) AS numbers, round(avg(length(b)), 6) AS chars FROM n GROUP BY status")
def ev20(spark, sf_dir):
    """Measures taken anew from saved results (a JSON document a row), without a model, and reported by subset."""
    saved = questions(spark, sf_dir).select(F.to_json(F.struct("qid", F.struct(F.col("status").alias("subset")).alias("row"), F.col("predicted").alias("prediction"))).alias("saved"))
    r = saved.select(F.from_json("saved", "qid long, row struct<subset:string>, prediction string").alias("r")).select("r.qid", "r.row.subset", "r.prediction")
    m = r.select("subset", A.refusal(F.col("prediction")).alias("refused"), A.answer_body(F.col("prediction")).alias("body"), F.size(A.answer_numbers(F.col("prediction"))).alias("numbers"))
    return m.groupBy("subset").agg(F.count("*").alias("rows"), F.count_if("refused").alias("refused"), F.count_if(F.col("body") == "").alias("blank"), F.round(F.avg("numbers"), 6).alias("numbers"), F.round(F.avg(F.length("body")), 6).alias("chars"))


_KS = "(SELECT unnest([1, 3, 5, 10]) AS k)"
#: Documents of a question's evidence at their first place, against those that it asks for.
_RANKED_SQL = f"rk AS (SELECT qid, source_file, row_number() OVER (PARTITION BY qid ORDER BY min(pos), source_file) AS rank FROM ev GROUP BY qid, source_file), gd AS (SELECT qid, count(*) AS gold FROM docs GROUP BY qid), rl AS (SELECT rk.qid, rank, count(*) OVER (PARTITION BY rk.qid ORDER BY rank) AS hits FROM rk JOIN docs USING (qid, source_file)), rm AS (SELECT gd.qid, k, gold, count(rank) AS rel, max(1e0 / rank) AS rr, coalesce(sum(CAST(hits AS DOUBLE) / rank), 0) AS ap, coalesce(sum(1e0 / log2(rank + 1)), 0) AS dcg FROM gd CROSS JOIN {_KS} LEFT JOIN rl ON rl.qid = gd.qid AND rank <= k GROUP BY ALL), rs AS (SELECT qid, CAST(k AS INT) AS k, round(CAST(rel AS DOUBLE) / gold, 6) AS recall, round(coalesce(rr, 0), 6) AS mrr, round(ap / least(gold, k), 6) AS map, round(dcg / list_sum(list_transform(range(1, least(gold, k) + 1), lambda i: 1e0 / log2(i + 1))), 6) AS ndcg, CAST(rel >= gold AS DOUBLE) AS complete_recall FROM rm)"


@query("ev09_document_ranking", f"WITH {EV_SQL}, {Q_SQL}, {DOCS_SQL}, {_RANKED_SQL} SELECT * FROM rs")
def ev09_documents(spark, sf_dir):
    """How the documents of a question's evidence rank those that it asks for; complete recall wants all of them."""
    return evaluate.ranking_of_names(evidence(spark, sf_dir).select("qid", "pos", "source_file"), documents_of(spark, sf_dir), "source_file")


_TOKENS = [f"list_filter(list_transform(list_filter(list_transform(regexp_extract_all(lower({_BODY.format(c)}), '{X.SEARCH_PATTERN}'), lambda t: trim(t, '{X.STRIPPED}')), lambda t: t <> '' AND t NOT IN ({', '.join(chr(39) + w + chr(39) for w in X.SEARCH_STOPWORDS)})), lambda t: replace(t, ',', '')), lambda t: true)" for c in ("expected", "predicted")]


@query("ev20_rescored", f"""WITH {EV_SQL}, {Q_SQL}, {DOCS_SQL}, {_RANKED_SQL}, tk AS (SELECT qid, {_TOKENS[0]} AS e, {_TOKENS[1]} AS p, {_REFUSED} AS refused FROM q), ct AS (SELECT qid, sum(least(x, y)) AS c FROM (SELECT qid, t, sum(x) AS x, sum(y) AS y FROM (SELECT qid, unnest(e) AS t, 1 AS x, 0 AS y FROM tk UNION ALL SELECT qid, unnest(p), 0, 1 FROM tk) GROUP BY ALL) GROUP BY qid),
ov AS (SELECT qid, refused, CASE WHEN len(e) = 0 AND len(p) = 0 THEN 1e0 WHEN len(e) = 0 OR len(p) = 0 THEN 0e0 ELSE round(2 * CAST(coalesce(c, 0) AS DOUBLE) / (len(e) + len(p)), 6) END AS f1 FROM tk LEFT JOIN ct USING (qid)) SELECT ov.qid, CAST(k.k AS INT) AS k, refused, f1, rs.recall AS document_recall, rs.ndcg AS document_ndcg, rs.complete_recall AS document_complete_recall FROM ov CROSS JOIN {_KS} k LEFT JOIN rs ON rs.qid = ov.qid AND rs.k = k.k""")
def ev20_rescored(spark, sf_dir):
    """Saved results scored anew: overlap, refusals and the ranking of documents at each cutoff."""
    return rescored_of(spark, sf_dir).select("qid", "k", "refused", "f1", "document_recall", "document_ndcg", "document_complete_recall")


def rescored_of(spark, sf_dir) -> DataFrame:
    found = evidence(spark, sf_dir).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_file"))), lambda x: x["source_file"]).alias("found"))
    wanted = documents_of(spark, sf_dir).groupBy("qid").agg(F.sort_array(F.collect_set("source_file")).alias("sources"))
    none = F.array().cast("array<string>")
    saved = questions(spark, sf_dir).select("qid", "expected", "predicted").join(found, "qid", "left").join(wanted, "qid", "left").withColumns({"found": F.coalesce("found", none), "sources": F.coalesce("sources", none)})
    return evaluate.rescored(saved, "expected", "predicted", "sources", "found")


def ledger_of(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, evidence and calculations of all questions: what the audit takes."""
    ev = evidence(spark, sf_dir).select("qid", "ref", "company", F.col("fiscal_year").alias("year"), "content")
    calculations = questions(spark, sf_dir).where("qid % 4 = 1").select("qid", F.lit("C1").alias("ref"))
    return questions(spark, sf_dir).select("qid", F.col("predicted").alias("answer")), ev, calculations


@query("au01_citation_audit")
def au01(spark, sf_dir):
    return audit.citation_issues(*ledger_of(spark, sf_dir))


@query("au04_issue_counts")
def au04(spark, sf_dir):
    """Issues without repeats by code, and the valid answers."""
    codes = F.transform("issues", lambda i: i["code"])
    each = audit.audited(*ledger_of(spark, sf_dir)).select(F.explode(F.when(F.size("issues") > 0, codes).otherwise(F.array(F.lit("valid")))).alias("code"), F.lit(1).cast("long").alias("n"))
    # valid answers have a row even if there are none
    return each.unionByName(spark.range(1).select(F.lit("valid").alias("code"), F.lit(0).cast("long").alias("n"))).groupBy("code").agg(F.sum("n").alias("n"))


@query("au06_uncited_tasks", rf"""WITH {EV_SQL}, {Q_SQL}, t AS (SELECT DISTINCT qid, unnest([company, other]) AS company, predicted FROM q), m AS (SELECT t.qid, t.company, bool_or(contains(upper({_MAIN.format('predicted')}), '[' || ref || ']')) AS cited FROM t JOIN ev ON t.qid = ev.qid AND t.company = ev.company GROUP BY ALL)
SELECT qid, 'uncited_task' AS gap, company AS task FROM m WHERE NOT cited UNION ALL SELECT qid, 'missing_comparison', '' FROM q WHERE qid % 3 = 1 AND NOT (contains(lower({_BODY.format('predicted')}), lower(company)) AND contains(lower({_BODY.format('predicted')}), lower(other)))""")
def au06(spark, sf_dir):
    """Gaps of answers: tasks with evidence of which none is cited, and comparisons that don't name both companies."""
    q = questions(spark, sf_dir)
    return audit.coverage_gaps(
        q.select("qid", F.explode(F.array_distinct(F.array("company", "other"))).alias("task")),
        evidence(spark, sf_dir).select("qid", F.col("company").alias("task"), "ref"),
        q.select("qid", "predicted", F.when(F.col("qid") % 3 == 1, F.array("company", "other")).alias("compared")), "predicted",
    )


@query("au08_judge", "SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN least(1, event_id % 3) ELSE 0 END AS DOUBLE) AS score, event_id % 4 = 0 AS answer_correct, event_id % 4 = 1 AS answer_grounded, CASE WHEN event_id % 4 = 1 THEN true END AS calculation_correct, CAST(CASE WHEN event_id % 4 = 1 THEN 500 ELSE 0 END AS BIGINT) AS reason_chars FROM events")
def au08(spark, sf_dir):
    """Verdicts in noisy texts: scores out of range, without a number, null calculations, a long reason, no object."""
    k = F.col("event_id") % 4
    noisy = (
        F.when(k == 0, F.concat(F.lit('Verdict: {"score": '), (F.col("event_id") % 3).cast("string"), F.lit(', "answer_correct": true, "calculation_correct": null} end')))
        .when(k == 1, F.concat(F.lit('{"score": -1, "answer_grounded": true, "calculation_correct": true, "reason": "'), F.lit("x" * 600), F.lit('"}')))
        .when(k == 2, F.lit('ok {"score": "n/a", "context_has_answer": true}')).otherwise("no object")
    )
    j = audit.judge_result(table(spark, sf_dir, "events").select("event_id", noisy.alias("t")), "t")
    return j.select("event_id", "score", "answer_correct", "answer_grounded", "calculation_correct", F.length("reason").cast("long").alias("reason_chars"))


_ADDED = ", ".join(f"CASE WHEN contains(lower(question), '{k}') THEN '{v}' END" for k, v in A.SYNONYMS)


_DISCUSSED = "CASE WHEN contains(lower(question), 'item 7') AND regexp_matches(question, 'description|financial statement (item|term)') THEN '" + A.DISCUSSION_TERMS + "' END"
_VARIED = "concat(question, CASE qid % 5 WHEN 0 THEN ' in its description' WHEN 1 THEN ' by financial statement item' WHEN 2 THEN ' by term' ELSE '' END)"


@query("tx14_expanded_query", f"WITH {Q_SQL}, v AS (SELECT qid, {_VARIED} AS question FROM q) SELECT qid, concat_ws(' ', question, {_ADDED}, {_DISCUSSED}) AS expanded FROM v")
def tx14(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", A.expanded_query(F.expr(_VARIED)).alias("expanded"))


_RAW = "CASE l_linenumber % 4 WHEN 0 THEN concat('(', CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), ')') WHEN 1 THEN concat('$ ', CAST(CAST(floor(l_quantity) AS INT) AS STRING), '. 63 million') WHEN 2 THEN concat('1,', CAST(100 + CAST(floor(l_quantity) AS INT) AS STRING), '.5') ELSE 'none stated' END"


@query("tx16_decimals", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_linenumber % 4 WHEN 0 THEN -CAST(l_extendedprice AS DECIMAL(12,2)) WHEN 1 THEN CAST(floor(l_quantity) AS INT) + 0.63 WHEN 2 THEN 1100 + CAST(floor(l_quantity) AS INT) + 0.5 END AS DOUBLE) AS value FROM lineitem")
def tx16(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.raw_decimal(F.expr(_RAW)).cast("double").alias("value"))


_NAMES = ["Total net sales (2)", "Consolidated Revenues", "Streaming revenues", "Net earnings", "Change in net income", "EPS - Diluted", "Basic earnings per share (1)", "Operating profit", "Assets, total", "Pre-tax income", "Income tax expense", "Executive age", "Cash, cash equivalents and short-term investments", "Gross margin (3)"]
_CANONICAL = ["total revenue", "total revenue", "streaming revenue", "net income", "net income change", "diluted earnings per share", "basic earnings per share", "operating income", "total assets", "income before tax", "income taxes", "age", "total cash cash equivalents short term investments", "gross margin"]


@query("tx18_metric_names", "SELECT p_partkey, [" + ", ".join(f"'{n}'" for n in _CANONICAL) + "][1 + CAST(p_partkey % 14 AS INT)] AS metric FROM part")
def tx18(spark, sf_dir):
    said = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % 14).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", A.metric_name(said).alias("metric"))


@query("lg17_operator_names", "SELECT o_orderkey, ['SUM', 'DIFFERENCE', 'RATIO', 'MARGIN', 'CAGR', 'NONE', 'NONE'][1 + CAST(o_orderkey % 7 AS INT)] AS operator FROM orders")
def lg17(spark, sf_dir):
    from ..operators.ledger import operator_name

    said = F.get(F.array(*[F.lit(x) for x in (" add", "Subtract", "DIVIDE", "percent_of_total", "cagr", "unknown", "")]), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", operator_name(said).alias("operator"))
