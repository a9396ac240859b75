"""Queries on the citation audit and on what is shown of an answer that fails it, with SQL of the audit's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, enforcement
from ..operators.enforcement import BLOCKED, HEADS, WARNING
from .base import ORACLES, query, table
from .cases import EV_SQL, Q_SQL, evidence

_CLAIM = r"regexp_matches(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)\b[EFC]\d+\b', '', 'g'), '^\s*(?:[-*#>]\s*)*(?:\*{0,2})?\d+[.)、](?:\*{0,2})?\s*', ''), '(?i)\b(?:FY\s*)?20\d{2}\b|\b(?:Item|Part|Section|Note)\s+\d+[A-Z]?(?:\.\d+)?\b|\b10-[KQ]\b', '', 'g'), '[$€£¥]|\b\d[\d,.]*%?\b')"
_DERIVED = rf"regexp_matches(raw, '{audit.DERIVED}') AND NOT regexp_matches(raw, '{audit.NOT_DERIVED.replace(chr(39), chr(39) * 2)}')"
_YEARS = "list_filter(regexp_extract_all({0}, '\\d+'), lambda y: length(y) = 4 AND starts_with(y, '20'))"


def audit_sql(n: str, answers: str, ev: str, ca: str, fa: str | None, key: str = "qid") -> str:
    """CTEs up to {n}is, the issues (key, code, sentence) of answers (key, answer) by ev (key, ref, company, year, content),
    ca (key, ref) and fa (key, ref, evidence, year). Words that are references are runs of letters and digits."""
    facts_known = f" UNION SELECT {key}, upper(ref) FROM {fa}" if fa else ""
    facts_years = f" UNION SELECT {key}, upper(evidence), CAST(year AS VARCHAR) FROM {fa}" if fa else ""
    return f"""{n}g AS (SELECT {key}, coalesce(answer, '') AS t FROM {answers}), {n}p AS (SELECT {key}, regexp_split_to_array(t, '\\r\\n|\\n|\\r') AS p FROM {n}g WHERE trim(t) <> ''),
{n}l AS (SELECT {key}, line, raw, trim(raw) AS sentence, list_distinct(list_filter(regexp_extract_all(upper(raw), '[A-Z0-9]+'), lambda x: regexp_full_match(x, '[EFC][0-9]+'))) AS refs, list_distinct({_YEARS.format('raw')}) AS years FROM (SELECT {key}, unnest(p) AS raw, generate_subscripts(p, 1) AS line FROM {n}p) WHERE trim(raw) <> ''),
{n}k AS (SELECT {key}, upper(ref) AS ref FROM {ev} UNION SELECT {key}, upper(ref) FROM {ca}{facts_known}), {n}e AS (SELECT {key}, line, sentence, unnest(refs) AS ref FROM {n}l),
{n}j AS (SELECT e.*, k.ref IS NOT NULL AS known FROM {n}e e LEFT JOIN {n}k k ON e.{key} = k.{key} AND e.ref = k.ref),
{n}y AS (SELECT {key}, upper(ref) AS ref, unnest({_YEARS.format('content')}) AS y FROM {ev} UNION SELECT {key}, upper(ref), CAST(year AS VARCHAR) FROM {ev}{facts_years}),
{n}c AS (SELECT e.{key}, e.line, list(DISTINCT upper(v.company)) FILTER (WHERE v.company IS NOT NULL) AS companies, list(DISTINCT y.y) FILTER (WHERE y.y IS NOT NULL) AS supported FROM {n}e e LEFT JOIN {ev} v ON e.{key} = v.{key} AND e.ref = upper(v.ref) LEFT JOIN {n}y y ON y.{key} = e.{key} AND y.ref = e.ref AND v.ref IS NOT NULL WHERE starts_with(e.ref, 'E') GROUP BY ALL),
{n}n AS (SELECT {key}, list(DISTINCT upper(company)) AS names FROM {ev} WHERE trim(company) <> '' GROUP BY {key}),
{n}b AS (SELECT l.*, coalesce(companies, []) AS companies, coalesce(supported, []) AS supported, coalesce(names, []) AS names FROM {n}l l JOIN {n}c c ON l.{key} = c.{key} AND l.line = c.line LEFT JOIN {n}n m ON m.{key} = l.{key}),
{n}d AS (SELECT {key}, line, bool_and(known) AS grounded FROM {n}j WHERE starts_with(ref, 'C') GROUP BY ALL), {n}o AS (SELECT DISTINCT {key}, left(ref, 1) AS kind FROM {n}j WHERE known),
{n}is AS (SELECT {key}, 'empty_answer' AS code, '' AS sentence FROM {n}g WHERE trim(t) = '' UNION SELECT {key}, 'unknown_reference', sentence FROM {n}j WHERE NOT known
UNION SELECT {key}, 'missing_evidence', '' FROM {n}p WHERE {key} IN (SELECT {key} FROM {ev}) AND {key} NOT IN (SELECT {key} FROM {n}o WHERE kind = 'E')
UNION SELECT {key}, 'missing_calculation', '' FROM {n}p WHERE {key} IN (SELECT {key} FROM {ca}) AND {key} NOT IN (SELECT {key} FROM {n}o WHERE kind = 'C')
UNION SELECT {key}, 'unverified_calculation', sentence FROM {n}l WHERE {_DERIVED} AND NOT list_bool_or(list_transform(refs, lambda x: starts_with(x, 'C')) || [false])
UNION SELECT l.{key}, 'uncited_numeric_claim', sentence FROM {n}l l LEFT JOIN {n}d d ON l.{key} = d.{key} AND l.line = d.line WHERE {_CLAIM} AND NOT list_bool_or(list_transform(refs, lambda x: starts_with(x, 'E')) || [false]) AND NOT coalesce(grounded, false) AND NOT (lower(sentence) IN ('来源', '来源：', 'sources') OR starts_with(lower(sentence), 'sources:'))
UNION SELECT {key}, 'company_mismatch', sentence FROM {n}b WHERE len(list_filter(names, lambda c: regexp_matches(' ' || upper(raw) || ' ', '[^A-Z0-9-]' || c || '[^A-Z0-9-]') AND NOT list_contains(companies, c))) > 0
UNION SELECT {key}, 'year_mismatch', sentence FROM {n}b WHERE len(list_filter(years, lambda y: NOT list_contains(supported, y))) > 0)"""


@query("au02_numeric_claims", f"WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS t0 FROM conversations), v AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN t0 WHEN 1 THEN '2) See Item 7A of FY2024, 10-K [E1][F12]' WHEN 2 THEN '- **3.** ' || left(t0, 40) ELSE 'E' || conv_id || ' and ' || conv_id || 'x' END AS raw FROM t) SELECT conv_id, turn, {_CLAIM} AS claim FROM v")
def au02(spark, sf_dir):
    """Whether a line states an amount: references, list numbers, years, items and forms are none."""
    t = F.coalesce("text", F.lit(""))
    line = F.when(F.col("turn") % 4 == 0, t).when(F.col("turn") % 4 == 1, "2) See Item 7A of FY2024, 10-K [E1][F12]").when(F.col("turn") % 4 == 2, F.concat(F.lit("- **3.** "), F.substring(t, 1, 40))).otherwise(F.concat(F.lit("E"), F.col("conv_id").cast("string"), F.lit(" and "), F.col("conv_id").cast("string"), F.lit("x")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", audit.claims_number(line).alias("claim"))


_LEDGER = f"{EV_SQL}, {Q_SQL}, an AS (SELECT qid, predicted AS answer FROM q), e2 AS (SELECT qid, ref, company, fiscal_year AS year, content FROM ev), ca AS (SELECT qid, 'C1' AS ref FROM q WHERE qid % 4 = 1)"
ORACLES["au01_citation_audit"] = f"WITH {_LEDGER}, {audit_sql('x', 'an', 'e2', 'ca', None)} SELECT qid, code, sentence FROM xis"
ORACLES["au04_issue_counts"] = f"WITH {_LEDGER}, {audit_sql('x', 'an', 'e2', 'ca', None)} SELECT code, count(*) AS n FROM xis GROUP BY code UNION ALL SELECT 'valid', count(*) FROM an WHERE qid NOT IN (SELECT qid FROM xis)"

#: Rows to be enforced: what each eighth of the questions is answered, by its first row of evidence.
_CASE = {
    "question": "CASE qid % 8 WHEN 3 THEN concat('What was net income in billion for fiscal year ', CAST(fiscal_year AS STRING), ' of ', company, '?') ELSE concat('How much was it for ', company, '?') END",
    "answer": "CASE qid % 8 WHEN 0 THEN concat(company, ' had ', CAST(amount AS STRING), ' in ', CAST(fiscal_year AS STRING), ' [E1]') "
    "WHEN 1 THEN concat('Found: ', company, ' had ', CAST(amount AS STRING), ' in ', CAST(fiscal_year AS STRING), ' [E1]', chr(10), '  It also had 12 units.', chr(10), chr(10), chr(10), chr(10), 'All [E1].') "
    "WHEN 4 THEN CASE WHEN qid % 16 = 4 THEN '' ELSE 'It was 5 [E99]' END WHEN 6 THEN '净利润为净利润为 5 E99' ELSE 'It was 5 [E99]' END",
}
#: Calculations: one of some questions, by its two first facts, or a count of the year of the first row.
_CALC = {
    "type": "CASE WHEN qid % 8 = 3 THEN 'count' WHEN qid % 3 = 0 THEN 'multiple' ELSE 'percentage_change' END",
    "expression": "CASE WHEN qid % 8 = 3 THEN concat('count(', CAST(fiscal_year AS STRING), ')') ELSE 'F2 / F1' END",
    "display": "CASE WHEN qid % 8 = 3 THEN '1' ELSE CAST(amount AS STRING) END",
    "scale": "CASE WHEN qid % 5 = 0 THEN 'million' ELSE 'unit' END",
    "unit": "'usd'",
    "ids": "CASE WHEN qid % 8 = 3 THEN '' ELSE 'f2|F1|F9' END",
}
_FACT = {
    "ref": "concat('F', CAST(pos AS STRING))", "evidence": "ref", "company": "company", "year": "CAST(fiscal_year AS STRING)", "metric": "CASE WHEN qid % 8 = 3 THEN 'Net income' ELSE metric END",
    "raw_value": "concat('$', CAST(amount AS STRING), ' ', scale)", "value": "amount", "scale": "scale",
}


def _cols(d: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in d.items())


_HAS_CALC = "pos = 1 AND qid % 8 IN (2, 3, 6)"
_HAS_FACT = "pos <= 3 AND qid % 8 <> 5"
_MARKED = "list_transform({0}, lambda x: '[' || x || ']')"
_SOURCE = "(SELECT string_agg('[' || x.ref || '] ' || x.source_file, chr(10) ORDER BY i) FROM (SELECT unnest({0}) AS r, generate_subscripts({0}, 1) AS i) s JOIN ev x ON x.qid = {1} AND x.ref = s.r)"
ENFORCED_SQL = f"""{EV_SQL}, aw AS (SELECT qid, {_cols(_CASE)}, qid % 8 <> 7 AS strict FROM ev WHERE pos = 1), e2 AS (SELECT qid, ref, company, fiscal_year AS year, content FROM ev), ca AS (SELECT qid, 'C1' AS ref, {_cols(_CALC)}, fiscal_year FROM ev WHERE {_HAS_CALC}),
f0 AS (SELECT qid, pos, {_cols({k: 'ev.' + v if v in ('ref', 'company', 'scale') else v for k, v in _FACT.items()})} FROM ev WHERE {_HAS_FACT}), {audit_sql('x', 'aw', 'e2', 'ca', 'f0')},
bad AS (SELECT aw.*, codes, unsafe, details FROM aw JOIN (SELECT qid, list(DISTINCT code) AS codes, list(DISTINCT trim(sentence)) AS unsafe, list_sort(list(DISTINCT concat_ws(': ', code, nullif(sentence, ''))))[1:5] AS details FROM xis GROUP BY qid) USING (qid)),
cut AS (SELECT qid, 1 AS n, regexp_replace(regexp_replace(array_to_string(list_filter(regexp_split_to_array(answer, '\\r\\n|\\n|\\r'), lambda x: NOT list_contains(unsafe, trim(x))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS answer, answer AS old FROM bad WHERE len(list_filter(codes, lambda c: c NOT IN ('uncited_numeric_claim', 'company_mismatch', 'year_mismatch'))) = 0),
op AS (SELECT bad.qid, any_value(c.type) AS type, any_value(c.display) AS display, any_value(c.scale) AS scale, any_value(c.unit) AS unit, any_value(bad.question) AS question, list(f ORDER BY o.k) AS fs FROM bad JOIN ca c USING (qid) JOIN (SELECT 1 AS k, 'F2' AS id UNION ALL SELECT 2, 'F1') o ON c.ids <> '' JOIN f0 f ON f.qid = bad.qid AND f.ref = o.id WHERE bad.strict AND NOT contains(bad.answer, '净') AND bad.answer <> '' GROUP BY bad.qid),
sm AS (SELECT qid, 2 AS n, array_to_string(list_transform(list_sort(list_transform(fs, lambda f, i: {{'a': CASE WHEN strpos(upper(question), f.company) = 0 THEN 99999 ELSE strpos(upper(question), f.company) END, 'i': i, 'f': f}})), lambda x: x.f.company || ' FY' || x.f.year || ' ' || lower(x.f.metric) || ' was ' || x.f.raw_value || ' [' || x.f.ref || '][' || x.f.evidence || ']'), '; ') || '. ' ||
 CASE WHEN type = 'multiple' AND len(fs) = 2 THEN fs[1].company || '''s value was approximately ' || display || ' times larger than ' || fs[2].company || '''s' ELSE 'The ' || replace(type, '_', ' ') || ' was ' || display || CASE WHEN scale = 'unit' THEN ' ' || unit ELSE ' ' || scale || ' ' || unit END END || ' [C1]' || array_to_string({_MARKED.format('list_transform(fs, lambda f: f.evidence)')}, '') || '.' || chr(10) || chr(10) || 'Sources:' || chr(10) || {_SOURCE.format('list_transform(fs, lambda f: f.evidence)', 'op.qid')} AS answer FROM op),
qs AS (SELECT bad.qid, 3 AS n, f.company || ' fiscal ' || f.year || ' net income was ' || CASE WHEN f.scale = 'million' THEN '$' || CAST(CAST(round(CAST(f.value AS DECIMAL(30,6)) / 1000, 1) AS DECIMAL(30,1)) AS VARCHAR) || ' billion' ELSE f.raw_value END || ' [' || f.ref || '][' || f.evidence || ']' || chr(10) || 'The table covers 1 fiscal years (' || CAST(c.fiscal_year AS VARCHAR) || ') [C1][' || h.ref || ']' || chr(10) || chr(10) || 'Sources:' || chr(10) || {_SOURCE.format('list_filter([f.evidence, h.ref], lambda x, i: i = 1 OR x <> f.evidence)', 'bad.qid')} AS answer
 FROM bad JOIN ca c ON c.qid = bad.qid AND c.type = 'count' JOIN (SELECT qid, arg_min(struct_pack(company, year, value, scale, raw_value, ref, evidence), pos) AS f FROM f0 JOIN (SELECT qid, CAST(fiscal_year AS VARCHAR) AS fy FROM ev WHERE pos = 1) y USING (qid) WHERE year = fy GROUP BY qid) ff ON ff.qid = bad.qid JOIN (SELECT ca.qid, arg_min(ev.ref, ev.pos) AS ref FROM ca JOIN ev ON ev.qid = ca.qid AND contains(ev.content, CAST(ca.fiscal_year AS VARCHAR)) GROUP BY ca.qid) h ON h.qid = bad.qid CROSS JOIN (SELECT 1) z WHERE bad.strict AND bad.qid % 8 = 3),
tr AS (SELECT qid, n, answer, qid * 10 + n AS key FROM (SELECT qid, n, answer FROM cut WHERE answer <> old UNION ALL SELECT * FROM sm UNION ALL SELECT * FROM qs) WHERE trim(answer) <> ''),
e3 AS (SELECT key, e2.* FROM e2 JOIN tr USING (qid)), c3 AS (SELECT key, ca.ref FROM ca JOIN tr USING (qid)), f3 AS (SELECT key, f0.* FROM f0 JOIN tr USING (qid)), {audit_sql('z', 'tr', 'e3', 'c3', 'f3', 'key')},
us AS (SELECT f0.*, c.qid IS NOT NULL AND c.ids <> '' AS sums FROM f0 LEFT JOIN ca c USING (qid)), sh AS (SELECT * FROM us WHERE NOT sums OR ref IN ('F1', 'F2') OR starts_with(lower(metric), 'total ')),
fl AS (SELECT qid, string_agg('- ' || company || ' FY' || year || ' | ' || metric || ' = ' || raw_value || ' [' || ref || '][' || evidence || ']' || chr(10), '' ORDER BY pos) AS facts FROM sh GROUP BY qid),
ct AS (SELECT ca.qid, arg_min(ev.ref, ev.pos) AS of FROM ca JOIN ev ON ev.qid = ca.qid AND contains(ev.content, CAST(ca.fiscal_year AS VARCHAR)) WHERE type = 'count' GROUP BY ca.qid),
cl AS (SELECT ca.qid, '- ' || type || ': ' || expression || ' = ' || display || ' ' || scale || ' ' || unit || ' [C1]' || coalesce((SELECT string_agg('[' || evidence || ']', '' ORDER BY ref DESC) FROM f0 WHERE f0.qid = ca.qid AND f0.ref IN ('F1', 'F2') AND ca.ids <> ''), '') || coalesce('[' || of || ']', '') || chr(10) AS sums FROM ca LEFT JOIN ct USING (qid)),
ci AS (SELECT qid, evidence AS ref, min(k) AS k FROM (SELECT qid, evidence, pos AS k FROM sh UNION ALL SELECT qid, of, 1000 FROM ct) GROUP BY ALL), so AS (SELECT ci.qid, string_agg('[' || ev.ref || '] ' || source_file || ' — ' || item || chr(10), '' ORDER BY k) AS sources FROM ci JOIN ev USING (qid, ref) GROUP BY ci.qid),
lg AS (SELECT bad.qid, 4 AS n, contains(answer, 'It') AS en, facts, sums, sources FROM bad JOIN fl USING (qid) LEFT JOIN cl USING (qid) LEFT JOIN so USING (qid) WHERE strict),
lt AS (SELECT qid, n, rtrim(CASE WHEN en THEN '{HEADS['facts'][0]}' ELSE '{HEADS['facts'][1]}' END || facts || CASE WHEN sums IS NULL THEN '' WHEN en THEN '{HEADS['calculations'][0]}' || sums ELSE '{HEADS['calculations'][1]}' || sums END || CASE WHEN en THEN '{HEADS['sources'][0]}' ELSE '{HEADS['sources'][1]}' END || coalesce(sources, ''), chr(10)) AS answer FROM lg),
al AS (SELECT qid, 0 AS n, answer FROM aw WHERE qid NOT IN (SELECT qid FROM xis) UNION ALL SELECT qid, n, answer FROM tr WHERE key NOT IN (SELECT key FROM zis) UNION ALL SELECT * FROM lt
UNION ALL SELECT qid, 5, rtrim(answer) || '{WARNING}' || array_to_string(list_transform(details, lambda d: '- ' || d), chr(10)) FROM bad WHERE NOT strict UNION ALL SELECT qid, 6, '{BLOCKED[0]}' || array_to_string(list_transform(details, lambda d: '- ' || d), chr(10)) || '{BLOCKED[1]}' FROM bad WHERE strict)"""


@query("au05_enforced_answers", f"WITH {ENFORCED_SQL} SELECT qid, ['valid', 'salvaged', 'calculation', 'question', 'ledger', 'warning', 'blocked'][1 + min(n)] AS rung, md5(arg_min(answer, n)) AS answer_md5 FROM al GROUP BY qid")
def au05(spark, sf_dir):
    """What is shown of each answer: an eighth of the questions each has one that is valid, that dropping lines mends,
    that calculations or the asked fact replace, that only the ledger replaces, in either language, and so on."""
    out = enforcement.enforced_rows(enforced_cases(spark, sf_dir))
    return out.select("qid", "rung", F.md5("answer").alias("answer_md5"))


def enforced_cases(spark, sf_dir) -> DataFrame:
    """A row for each question with its answer, evidence, facts and calculations, all of one pass over the evidence."""
    ev = evidence(spark, sf_dir).withColumns({"year": F.col("fiscal_year"), "section": F.lit(" ")})
    own = lambda d, **more: F.struct(*[F.expr(e).alias(n) for n, e in {**more, **d}.items()])
    calculation = {**_CALC, "fact_ids": f"filter(split({_CALC['ids']}, '[|]'), x -> x <> '')", "ref": "'C1'", "pos": "1"}
    listed = lambda columns, when, d, name: F.array_sort(F.collect_list(F.when(F.expr(when), own({c: d[c] for c in columns})))).alias(name)
    answers = F.max(F.when(F.col("pos") == 1, own(_CASE, strict="qid % 8 <> 7"))).alias("own")
    made = ev.groupBy("qid").agg(
        answers, listed(enforcement.EVIDENCE, "true", {c: c for c in enforcement.EVIDENCE}, "evidence"),
        listed(enforcement.FACT, _HAS_FACT, {"pos": "pos", **_FACT}, "facts"), listed(enforcement.CALCULATION, _HAS_CALC, calculation, "calculations"),
    )
    return made.select("qid", "own.*", "evidence", "facts", "calculations")
