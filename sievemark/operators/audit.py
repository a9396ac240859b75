"""Answer audit: retrieval gate, citation checks, supported years."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NUMERIC_QUESTION, search_tokens

def retrieval_gate(questions: DataFrame, evidence: DataFrame, least: float = 0.5, floor: float = 0.0) -> DataFrame:
    """(qid, coverage, status) for each question: REJECT without evidence, for a numeric question without a number in the
    evidence, or if no term of the question is found; CAUTION below `least` coverage, or where the evidence's best model
    score is below `floor`; else PASS.

    evidence: qid, text and, if a model scored it, rerank_score (null: not scored). Evidence is reduced to the set of its
    terms before it is grouped by question.
    """
    score = F.col("rerank_score") if "rerank_score" in evidence.columns else F.lit(None).cast("double")
    terms = evidence.select("qid", F.explode(F.array_distinct(search_tokens(F.col("text")))).alias("t")).distinct()
    facts = evidence.groupBy("qid").agg(F.count("*").alias("n"), F.bool_or(F.col("text").rlike(r"\d")).alias("number"), F.max(score).alias("best"))
    q = questions.select("qid", F.col("question").rlike(NUMERIC_QUESTION).alias("numeric"), F.array_distinct(search_tokens(F.col("question"))).alias("qt"))
    asked = q.select("qid", F.explode("qt").alias("t"))
    matched = asked.join(terms, ["qid", "t"], "left_semi").groupBy("qid").agg(F.count("*").alias("matched"))
    j = q.join(facts, "qid", "left").join(matched, "qid", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    size = F.size("qt")
    coverage = F.when(size == 0, 1.0).otherwise(F.round(F.col("matched") / size, 6))
    reject = F.col("n").isNull() | (F.col("numeric") & ~F.coalesce("number", F.lit(False))) | ((size > 0) & (F.col("matched") == 0))
    weak = ((size > 0) & (F.col("matched") / size < least)) | F.coalesce(F.col("best") < floor, F.lit(False))
    return j.select("qid", coverage.alias("coverage"), F.when(reject, "REJECT").when(weak, "CAUTION").otherwise("PASS").alias("status"))


# Patterns of references, years, derived results and numeric claims.
REFERENCE = r"(?i)(?<![A-Z0-9])([EFC]\d+)(?![A-Z0-9])"
YEAR = r"(?<!\d)(20\d{2})(?!\d)"
FILING_IDENTIFIER = r"(?i)\b(?:FY\s*)?20\d{2}\b|\b(?:Item|Part|Section|Note)\s+\d+[A-Z]?(?:\.\d+)?\b|\b10-[KQ]\b"
DERIVED = r"(?i)(?:计算得出|按.+计算|calculated|computed|\([^\n)]*(?:F\d+|\d+(?:\.\d+)?)\s*[-+*/×÷]\s*(?:F\d+|\d+(?:\.\d+)?)[^\n)]*\))"
NOT_DERIVED = r"(?i)\b(?:cannot|can't|could not|not)\s+(?:be\s+)?(?:calculated|computed)\b|无法(?:计算|确定)"


def claims_number(line: Column) -> Column:
    """Whether a line states an amount: a currency sign or a number that isn't a reference, a list's, a year's or a
    filing's."""
    bare = F.regexp_replace(F.regexp_replace(line, REFERENCE, ""), r"^\s*(?:[-*#>]\s*)*(?:\*{0,2})?\d+[.)、](?:\*{0,2})?\s*", "")
    return F.regexp_replace(bare, FILING_IDENTIFIER, "").rlike(r"[$€£¥]|\b\d[\d,.]*%?\b")


def derives(line: Column) -> Column:
    """Whether a line matches DERIVED; without any of the characters that its alternatives begin with it isn't tried."""
    low = F.lower(line)
    hint = low.contains("calculated") | low.contains("computed") | line.contains("(") | line.contains("计算得出") | line.contains("按")
    return hint & line.rlike(DERIVED)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def supporting(content: Column, year: Column) -> Column:
    """The years that a row of evidence supports by itself: those of its text and its own."""
    return F.array_union(F.regexp_extract_all(content, F.lit(YEAR), F.lit(1)), F.array_compact(F.array(year.cast("string"))))


def issues(text: Column, evidence: Column, calculations: Column, facts: Column) -> Column:
    """Issues (code, sentence) of an answer, as citation_issues states them, without repeats.

    evidence: array of (ref, company, supported); calculations: array of refs; facts: array of (ref, evidence, year). All
    of a question lies in its row, so nothing is shuffled.
    """
    issue = lambda when, code, sentence: F.when(when, F.struct(F.lit(code).alias("code"), sentence.alias("sentence")))
    upper = lambda rows, name: F.transform(rows, lambda r: F.upper(r[name]))
    none = F.array().cast("array<string>")

    def read(raw: Column) -> Column:
        refs = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(REFERENCE), F.lit(1)), lambda r: F.upper(r)))
        return let(refs, lambda refs: F.struct(raw.alias("raw"), F.trim(raw).alias("sentence"), refs.alias("refs"), F.exists(refs, lambda r: r.startswith("E")).alias("evident"), F.exists(refs, lambda r: r.startswith("C")).alias("computed")))

    # what a line's marks or a few characters settle is asked before its patterns, which cost most
    def of_line(x: Column, known: Column, names: Column) -> Column:
        raw, sentence, refs = x["raw"], x["sentence"], x["refs"]
        unknown = F.exists(refs, lambda r: ~F.array_contains(known, r))
        grounded = x["computed"] & F.forall(refs, lambda r: ~r.startswith("C") | F.array_contains(known, r))
        derived = derives(raw) & ~raw.rlike(NOT_DERIVED)
        low = F.lower(sentence)
        heading = low.isin("来源", "来源：", "sources") | low.startswith("sources:")
        # years of the facts that lie on what is cited count too
        more = lambda e: F.transform(F.filter(facts, lambda f: F.upper(f["evidence"]) == F.upper(e["ref"])), lambda f: f["year"].cast("string"))
        token = lambda c: F.upper(raw).contains(c) & F.call_function("regexp_like", raw, F.concat(F.lit(r"(?i)(?<![A-Z0-9-])\Q"), c, F.lit(r"\E(?![A-Z0-9-])")))

        def mismatched(cited: Column) -> Column:
            supported = F.flatten(F.array_compact(F.transform(cited, lambda e: F.array_union(e["supported"], more(e)))))
            company = F.exists(names, lambda c: token(c) & ~F.array_contains(F.array_compact(upper(cited, "company")), c))
            year = F.exists(F.regexp_extract_all(raw, F.lit(YEAR), F.lit(1)), lambda y: ~F.array_contains(F.array_compact(supported), y))
            return F.array(issue(company, "company_mismatch", sentence), issue(year, "year_mismatch", sentence))

        cited = F.filter(evidence, lambda e: F.upper(e["ref"]).startswith("E") & F.array_contains(refs, F.upper(e["ref"])))
        own = F.array(
            issue(unknown, "unknown_reference", sentence), issue(~x["computed"] & derived, "unverified_calculation", sentence),
            issue(~x["evident"] & ~grounded & ~heading & claims_number(raw), "uncited_numeric_claim", sentence),
        )
        return F.array_compact(F.when(x["evident"], F.concat(own, let(cited, mismatched))).otherwise(own))

    def judged(s: Column) -> Column:
        cites = lambda kind: F.exists(s["lines"], lambda x: F.exists(x["refs"], lambda r: r.startswith(kind) & F.array_contains(s["known"], r)))
        whole = F.array_compact(F.array(
            issue((F.size(evidence) > 0) & ~cites("E"), "missing_evidence", F.lit("")), issue((F.size(calculations) > 0) & ~cites("C"), "missing_calculation", F.lit("")),
        ))
        return F.array_distinct(F.concat(whole, F.flatten(F.transform(s["lines"], lambda x: of_line(x, s["known"], s["names"])))))

    def answered(t: Column) -> Column:
        known = F.array_compact(F.concat(upper(evidence, "ref"), F.transform(calculations, lambda c: F.upper(c)), upper(facts, "ref")))
        names = F.filter(F.array_distinct(upper(evidence, "company")), lambda c: F.trim(c) != "")
        lines = F.transform(F.filter(F.split(t, r"\R"), lambda x: F.trim(x) != ""), read)
        return let(F.struct(known.alias("known"), F.coalesce(names, none).alias("names"), lines.alias("lines")), judged)

    empty = F.array(F.struct(F.lit("empty_answer").alias("code"), F.lit("").alias("sentence")))
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(F.trim(t) == "", empty).otherwise(answered(t)))


def audited(answers: DataFrame, evidence: DataFrame, calculations: DataFrame, facts: DataFrame | None = None, qid: str = "qid", text: str = "answer") -> DataFrame:
    """(qid, issues) of each answer; see citation_issues. Evidence, calculations and facts of a question are gathered in
    its row, each shuffled once by question: rows of evidence with the years that they support, without their text."""
    own = evidence.select(qid, F.struct("ref", "company", supporting(F.col("content"), F.col("year")).alias("supported")).alias("_e")).groupBy(qid).agg(F.collect_list("_e").alias("_e"))
    sums = calculations.groupBy(qid).agg(F.collect_set("ref").alias("_c"))
    j = answers.select(qid, F.col(text).alias("_t")).join(own, qid, "left").join(sums, qid, "left")
    if facts is not None:
        j = j.join(facts.groupBy(qid).agg(F.collect_list(F.struct("ref", "evidence", "year")).alias("_f")), qid, "left")
    else:
        j = j.withColumn("_f", F.lit(None).cast("array<struct<ref:string,evidence:string,year:string>>"))
    full = [F.coalesce(c, F.array().cast(j.schema[c].dataType)) for c in ("_e", "_c", "_f")]
    return j.select(qid, issues(F.col("_t"), *full).alias("issues"))


def citation_issues(answers: DataFrame, evidence: DataFrame, calculations: DataFrame, facts: DataFrame | None = None, qid: str = "qid", text: str = "answer") -> DataFrame:
    """(qid, code, sentence): issues of each answer, without repeats; a valid answer has none.

    empty_answer; unknown_reference (a mark that evidence, facts and calculations don't have); missing_evidence and
    missing_calculation (there are some, but none is cited); unverified_calculation (a line derives a result without a
    calculation's mark); uncited_numeric_claim (a line states an amount without evidence or a known calculation);
    company_mismatch and year_mismatch (a line that cites evidence names a company of the evidence, or a year, that what
    it cites doesn't support). Lines are judged one by one. evidence: qid, ref, company, year, content; calculations:
    qid, ref; facts: qid, ref, evidence, year. Null answers count as empty.
    """
    each = audited(answers, evidence, calculations, facts, qid, text).select(qid, F.explode_outer("issues").alias("i"))
    return each.where("i is not null").select(qid, "i.code", "i.sentence").distinct()


def coverage_gaps(tasks: DataFrame, evidence: DataFrame, answers: DataFrame, text: str, qid: str = "qid") -> DataFrame:
    """(qid, gap, task): uncited_task (a task has evidence, but the answer's main part cites none of it) and
    missing_comparison (of the names to compare, one isn't in the body).

    tasks: qid, task; evidence: qid, task, ref; answers: qid, the text, compared (names, null if nothing is compared).
    """
    from ..functions.answers import answer_body, answer_main

    main = answers.select(qid, F.upper(answer_main(F.col(text))).alias("main"))
    has = tasks.join(evidence, [qid, "task"]).join(main, qid)
    cited = has.groupBy(qid, "task").agg(F.bool_or(F.col("main").contains(F.concat(F.lit("["), F.upper("ref"), F.lit("]")))).alias("cited"))
    body = F.lower(answer_body(F.col(text)))
    unnamed = answers.where(F.exists("compared", lambda c: ~body.contains(F.lower(c))))
    return cited.where(~F.col("cited")).select(qid, F.lit("uncited_task").alias("gap"), "task").unionByName(unnamed.select(qid, F.lit("missing_comparison").alias("gap"), F.lit("").alias("task")))


def judge_result(rows: DataFrame, text: str) -> DataFrame:
    """rows with a judge's verdict from the JSON object in a text: booleans (false unless stated true), a calculation's
    that may be null, a score within 0 and 1 (0 if it isn't a number), a reason of 500 characters at most."""
    from ..functions.text import json_object

    kind = "answer_correct boolean, context_has_answer boolean, answer_grounded boolean, calculation_correct boolean, score string, reason string"
    j = rows.withColumn("_j", F.from_json(json_object(F.col(text)), kind))
    yes = lambda c: F.coalesce(F.col(f"_j.{c}"), F.lit(False)).alias(c)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("_j.score").try_cast("double"), F.lit(0.0))))
    return j.select(*rows.columns, yes("answer_correct"), yes("context_has_answer"), yes("answer_grounded"), F.col("_j.calculation_correct").alias("calculation_correct"), score.alias("score"), F.substring(F.coalesce("_j.reason", F.lit("")), 1, 500).alias("reason"))


def supported_years(evidence: DataFrame, facts: DataFrame, qid: str = "ref") -> DataFrame:
    """Years that an evidence row supports: those in its text, its own, and those of its facts."""
    inside = evidence.select(qid, F.explode(F.regexp_extract_all("content", F.lit(YEAR), F.lit(1))).alias("y"))
    own = evidence.select(qid, F.col("year").cast("string").alias("y"))
    return inside.unionByName(own).unionByName(facts.select(qid, F.col("year").cast("string").alias("y"))).where("y is not null").groupBy(qid).agg(F.sort_array(F.collect_set("y")).alias("years"))
