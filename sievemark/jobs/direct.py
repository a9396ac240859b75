"""Queries on answers that filings give directly: listed phrases, ages, changed wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import direct, lexical
from .base import query, table
from .cases import EV_SQL, evidence, questions

#: What rows of evidence say besides, and what questions ask.
_SAID = (
    "concat(content, CASE fault WHEN 0 THEN ' Actual results, Financial position and cash generated from operations.' WHEN 1 THEN ' Financial condition; results of operations; cash flows from operations.' WHEN 2 THEN ' Actual results only.' "
    f"WHEN 3 THEN ' They may {direct.EARLIER}.' WHEN 4 THEN ' They may {direct.LATER.title()}.' ELSE ' The following MD&A is intended to assist.' END, "
    "CASE WHEN pos % 3 = 1 THEN concat(' Jane Doe (aged ', CAST(40 + (fiscal_year + pos) % 7 AS STRING), ') leads.') WHEN pos % 3 = 2 THEN ' Jane  Doe, age 77, and Mary Major, 9' ELSE concat(' Mary Major - ', CAST(50 + pos AS STRING), '; Jane Doe') END)"
)
_ASKED = {
    "list": "CASE qid % 4 WHEN 0 THEN 'How many distinct  terms are mentioned?' WHEN 1 THEN '有多少术语?' WHEN 2 THEN 'Count the items and their amount' ELSE 'How many are there?' END",
    "age": "CASE WHEN qid % 5 = 0 THEN '哪一年 age: Mary Major, Annual Report, Jane Doe' WHEN qid % 5 = 4 THEN 'Who is Jane Doe?' ELSE 'What age had Mary Major, what age Jane Doe?' END",
    "wording": "CASE WHEN qid % 2 = 0 THEN 'Which Language change of forward-looking text on cash generated  from operations is there?' ELSE 'Which change of forward-looking text?' END",
}
_DOCS = f"dc AS (SELECT qid, pos, ref, company, fiscal_year, source_file, item, {_SAID} AS c FROM ev)"


def documents(spark, sf_dir):
    return evidence(spark, sf_dir).select("qid", "pos", "ref", "company", F.col("fiscal_year").cast("string").alias("fiscal_year"), F.expr(_SAID).alias("content"), "source_file", "item", F.lit("Part II").alias("section"))


def asked(spark, sf_dir, kind):
    return questions(spark, sf_dir).select("qid", F.expr(_ASKED[kind]).alias("question"))


_G = [f"[{', '.join(chr(39) + p + chr(39) for p in g)}]" for g in direct.PHRASE_GROUPS]
_HAS = " UNION ALL ".join(f"SELECT *, {i} AS g FROM dc WHERE len(list_filter({g}, lambda p: NOT contains(lower(c), p))) = 0" for i, g in enumerate(_G))
_QUOTED = "array_to_string(list_transform({0}, lambda p: '''' || p || ''''), ', ')"


@query("lg20_listed_phrases", f"""WITH {EV_SQL}, {_DOCS}, h AS ({_HAS}), f AS (SELECT qid, company, min(pos) AS first FROM dc WHERE qid % 4 IN (0, 1) GROUP BY ALL), k AS (SELECT qid, company, min(g) AS g FROM h GROUP BY ALL), s AS (SELECT h.*, first, CASE h.g WHEN 0 THEN {_G[0]} ELSE {_G[1]} END AS ps FROM h JOIN k USING (qid, company, g) JOIN f USING (qid, company)),
r AS (SELECT qid, first, company, ps, company || ': 3 distinct items — ' || {_QUOTED.format('ps')} || ' ' || string_agg('[' || ref || ']', '' ORDER BY fiscal_year, pos) || chr(10) AS l FROM s GROUP BY qid, first, company, ps), w AS (SELECT qid, count(*) AS n, string_agg(l, '' ORDER BY first) AS ls, flatten(list(ps ORDER BY first)) AS ap FROM r GROUP BY qid), c AS (SELECT qid, string_agg('[' || ref || ']', '' ORDER BY first, fiscal_year, pos) AS refs, string_agg('[' || ref || '] ' || source_file || ' — ' || item, chr(10) ORDER BY first, fiscal_year, pos) AS so FROM s GROUP BY qid),
d AS (SELECT *, list_filter(ap, lambda p, i: NOT list_contains(ap[1:i-1], p)) AS dp FROM w) SELECT qid, md5(ls || CASE WHEN n > 1 THEN 'Total across all companies: ' || len(dp) || ' distinct terms — ' || {_QUOTED.format('dp')} || ' ' || refs || chr(10) ELSE '' END || chr(10) || 'Sources:' || chr(10) || so) AS answer_md5 FROM d JOIN c USING (qid)""")
def lg20_phrases(spark, sf_dir):
    return direct.listed_phrases(asked(spark, sf_dir, "list"), documents(spark, sf_dir)).select("qid", F.md5("answer").alias("answer_md5"))


_AGE = r"regexp_extract(c, '(?is)\b{0}\b\s*[,;(\-]?\s*(?:age[d]?\s*)?(1[89]|[2-9]\d)\b', 1)"


@query("lg20_ages", f"""WITH {EV_SQL}, {_DOCS}, x AS (SELECT *, 1 AS k, 'Mary Major' AS entity, {_AGE.format('Mary Major')} AS age FROM dc UNION ALL SELECT *, 2, 'Jane Doe', {_AGE.format('Jane Doe')} FROM dc), y AS (SELECT qid, k, entity, fiscal_year, arg_min(struct_pack(age, ref, source_file, item), pos) AS s FROM x WHERE age <> '' AND qid % 5 <> 4 AND qid IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
z AS (SELECT *, count(*) OVER (PARTITION BY qid, k) AS n FROM y), b AS (SELECT *, CAST(s.age AS INT) AS age FROM z WHERE n > 1 QUALIFY k = min(k) OVER (PARTITION BY qid)), g AS (SELECT *, row_number() OVER w AS i, lag(fiscal_year) OVER w AS py, age - lag(age) OVER w AS gap FROM b WINDOW w AS (PARTITION BY qid ORDER BY fiscal_year)),
t AS (SELECT qid, string_agg(CASE WHEN qid % 5 = 0 THEN fiscal_year || ' 财年，' || entity || '为 ' || age || ' 岁 [' || s.ref || ']。' ELSE 'In FY' || fiscal_year || ', ' || entity || ' was ' || age || ' years old [' || s.ref || ']' || CASE WHEN i = 2 THEN CASE WHEN gap >= 0 THEN ', an increase of ' ELSE ', a decrease of ' END || abs(gap) || CASE WHEN abs(gap) = 1 THEN ' year' ELSE ' years' END || ' from FY' || py ELSE '' END || '.' END, ' ' ORDER BY i) AS told,
max(CASE WHEN qid % 5 = 0 AND i = 2 THEN ' 相比 ' || py || ' 财年，' || fiscal_year || ' 财年' || CASE WHEN gap >= 0 THEN '增加 ' ELSE '减少 ' END || abs(gap) || ' 岁。' END) AS tail, string_agg('[' || s.ref || '] ' || s.source_file || ' — ' || s.item || ' Part II', chr(10) ORDER BY i) AS so FROM g GROUP BY qid)
SELECT qid, md5(told || coalesce(tail, '') || chr(10) || chr(10) || 'Sources:' || chr(10) || so) AS answer_md5 FROM t""")
def lg20_ages(spark, sf_dir):
    return direct.age_answers(asked(spark, sf_dir, "age"), documents(spark, sf_dir)).select("qid", F.md5("answer").alias("answer_md5"))


@query("lg20_wording", f"WITH {EV_SQL}, {_DOCS}, h AS (SELECT *, contains(lower(c), '{direct.EARLIER}') AS e, contains(lower(c), '{direct.LATER}') AS l, contains(lower(c), '{direct.STABLE}') AS s FROM dc WHERE qid % 2 = 0), a AS (SELECT qid, arg_min(struct_pack(ref, company, fiscal_year), pos) AS a FROM h WHERE e GROUP BY qid), b AS (SELECT qid, arg_min(ref, pos) AS b FROM h JOIN a USING (qid) WHERE l AND company = a.company AND fiscal_year <> a.fiscal_year GROUP BY qid), t AS (SELECT qid, company, min(pos) AS first, list(ref ORDER BY fiscal_year, pos) AS rs FROM h JOIN a USING (qid) WHERE s AND company <> a.company GROUP BY ALL HAVING count(*) > 1), u AS (SELECT qid, arg_min(rs, first) AS rs FROM t GROUP BY qid) SELECT qid, a.ref AS changed_earlier, b AS changed_later, rs[1] AS stable_earlier, rs[-1] AS stable_later FROM a JOIN b USING (qid) JOIN u USING (qid)")
def lg20_wording(spark, sf_dir):
    return direct.wording_changes(asked(spark, sf_dir, "wording"), documents(spark, sf_dir))


_PHRASED = "concat(CASE item_id % 4 WHEN 0 THEN 'Where do actual  results and Cash generated from operations' WHEN 1 THEN 'Where do financial condition and cash flows from operations' WHEN 2 THEN 'Where do actual results' ELSE 'How do actual results, cash generated from operations, financial condition and cash flows from operations' END, CASE item_id % 3 WHEN 0 THEN ' stand in item  8?' WHEN 1 THEN ' stand in Item 1a?' ELSE ' stand?' END)"


@query("sc09_phrase_conjunction", f"WITH {EV_SQL}, {_DOCS}, d AS (SELECT qid * 100 + pos AS doc_id, c, item, strpos(content, 'Table header') = 0 AS tx FROM dc JOIN (SELECT qid AS q2, pos AS p2, content FROM ev) ON qid = q2 AND pos = p2), q AS (SELECT item_id, CASE WHEN item_id % 4 IN (0, 3) THEN 0 ELSE 1 END AS g, CASE item_id % 3 WHEN 0 THEN 'item 8' WHEN 1 THEN 'item 1a' ELSE '' END AS asked FROM benchmark WHERE item_id % 4 <> 2), h AS (SELECT *, 0 AS g FROM d WHERE contains(lower(c), 'actual results') AND contains(lower(c), 'financial position') AND contains(lower(c), 'cash generated from operations') UNION ALL SELECT *, 1 FROM d WHERE contains(lower(c), 'financial condition') AND contains(lower(c), 'results of operations') AND contains(lower(c), 'cash flows from operations')), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY g ORDER BY tx DESC, length(c), doc_id) <= 40) SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY asked <> '' AND lower(item) <> asked, tx DESC, length(c), doc_id) AS INT) AS pos FROM f JOIN q USING (g) QUALIFY pos <= 5")
def sc09_conjunction(spark, sf_dir):
    """Documents that hold all phrases which a question calls for, those of its item first, texts before tables."""
    ev = evidence(spark, sf_dir)
    docs = ev.select((F.col("qid") * 100 + F.col("pos")).alias("doc_id"), F.expr(_SAID).alias("text"), (F.col("modality") == "text").alias("is_text"), "item")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.expr(_PHRASED).alias("text"))
    return lexical.phrase_scan(docs, asked, 5)
