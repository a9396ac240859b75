"""What is shown of an answer: itself if its citations hold, else the first of its fallbacks whose citations do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import YEAR, issues, let, supporting

# Faults that dropping a line mends, the question for a fiscal year's value, and the texts around fallbacks.
SALVAGEABLE = ["uncited_numeric_claim", "company_mismatch", "year_mismatch"]
REQUESTED_VALUE = r"(?is)what was.{0,120}?fiscal(?: year)?\s*(20\d{2})"
HEADS = {"facts": ("Verified facts:\n", "已核验事实：\n"), "calculations": ("\nDeterministic calculations:\n", "\n确定性计算：\n"), "sources": ("\nSources:\n", "\n来源：\n")}
BLOCKED = ("当前回答未通过引用校验，因此未输出未经证实的结论。\n\n校验问题：\n", "\n\n请重试，或在问题中补充明确的公司、财年和指标。")
WARNING = "\n\n> 引用校验警告\n"
MOST_ISSUES = 5
#: Columns of what a question has, each table's first by which it is ordered.
EVIDENCE = ["pos", "ref", "company", "year", "content", "source_file", "section", "item"]
FACT = ["pos", "ref", "evidence", "company", "year", "metric", "raw_value", "value", "scale"]
CALCULATION = ["pos", "ref", "type", "expression", "display", "scale", "unit", "fact_ids"]
#: The rungs, best first. The first three fallbacks are audited again; the ledger itself, a warning and a block aren't.
RUNGS = ["valid", "salvaged", "calculation", "question", "ledger", "warning", "blocked"]


def mostly_english(text: Column) -> Column:
    """Whether a text has more Latin letters than Chinese characters; an empty one doesn't."""
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    return F.coalesce(count("[A-Za-z]") > count("[一-鿿]"), F.lit(False))


def salvaged(answer: Column, unsafe: Column) -> Column:
    """The answer without its unsafe lines; runs of empty lines become one, ends are stripped."""
    lines = F.filter(F.split(answer, r"\r\n|\n|\r"), lambda x: ~F.array_contains(unsafe, F.trim(x)))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def listed(pos: Column | str, line: Column) -> Column:
    """Lines of a group as one array in order."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), line.alias("line")))), lambda x: x["line"])


def marks_of(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("["), x, F.lit("]"))), "")


def _in_order(rows: Column, place: Callable[..., Column], line: Callable[[Column], Column]) -> Column:
    return F.transform(F.array_sort(F.transform(rows, lambda r: F.struct(place(r).alias("p"), line(r).alias("line")))), lambda x: x["line"])


def operand_facts(ids: Column, facts: Column) -> Column:
    """Array of (k, f): the facts that a calculation is of, in the order of its ids; ids that no fact has are left out."""
    return F.flatten(F.transform(ids, lambda i, k: F.transform(F.filter(facts, lambda f: F.upper(f["ref"]) == F.upper(i)), lambda f: F.struct(k.alias("k"), f.alias("f")))))


def sources_of(ids: Column, evidence: Column) -> Column:
    """The files of cited evidence, a line each."""
    told = lambda e: F.concat(F.lit("["), e["ref"], F.lit("] "), e["source_file"])
    return F.array_join(F.flatten(F.transform(ids, lambda i: F.array_sort(F.transform(F.filter(evidence, lambda e: e["ref"] == i), told)))), "\n")


def calculation_answer(question: Column, evidence: Column, facts: Column, calculations: Column) -> Column:
    """The first calculation told with its facts, those first whose company the question names first, and with the sources
    of its evidence; null without any."""
    def told(c: Column, of: Column) -> Column:
        place = lambda o: F.struct(F.coalesce(F.nullif(F.call_function("locate", F.upper(o["f"]["company"]), F.upper(question)), F.lit(0)), F.lit(1 << 30)).alias("at"), o["k"].alias("k"))
        said = lambda o: F.concat(o["f"]["company"], F.lit(" FY"), o["f"]["year"], F.lit(" "), F.lower(o["f"]["metric"]), F.lit(" was "), o["f"]["raw_value"], F.lit(" ["), o["f"]["ref"], F.lit("]["), o["f"]["evidence"], F.lit("]"))
        ids = F.array_distinct(_in_order(of, lambda o: o["k"], lambda o: o["f"]["evidence"]))
        companies = _in_order(of, lambda o: o["k"], lambda o: o["f"]["company"])
        multiple = (F.lower(c["type"]) == "multiple") & (F.size(companies) == 2)
        shown = F.when(F.lower(c["scale"]) == "unit", F.concat(F.lit(" "), c["unit"])).otherwise(F.concat(F.lit(" "), c["scale"], F.lit(" "), c["unit"]))
        times = F.concat(F.get(companies, F.lit(0)), F.lit("'s value was approximately "), c["display"], F.lit(" times larger than "), F.get(companies, F.lit(1)), F.lit("'s"))
        conclusion = F.when(multiple, times).otherwise(F.concat(F.lit("The "), F.replace(c["type"], F.lit("_"), F.lit(" ")), F.lit(" was "), c["display"], shown))
        text = lambda i: F.concat(F.array_join(_in_order(of, place, said), "; "), F.lit(". "), conclusion, F.lit(" ["), c["ref"], F.lit("]"), marks_of(i), F.lit(".\n\nSources:\n"), sources_of(i, evidence))
        return F.when((F.size(of) > 0) & (F.trim(question) != ""), let(ids, text))

    return let(F.get(calculations, F.lit(0)), lambda c: F.when(c.isNotNull(), let(operand_facts(c["fact_ids"], facts), lambda of: told(c, of))))


def counted(c: Column, evidence: Column) -> Column:
    """(years, evidence) of a count: the years of its expression, and the first evidence whose text has all of them (null
    if none has); null for other calculations."""
    def held(years: Column) -> Column:
        rows = F.filter(evidence, lambda e: (F.size(years) > 0) & F.forall(years, lambda y: e["content"].contains(y)))
        return F.struct(years.alias("years"), F.get(rows, F.lit(0))["ref"].alias("evidence"))

    return F.when(F.lower(c["type"]) == "count", let(F.array_distinct(F.regexp_extract_all(c["expression"], F.lit(YEAR), F.lit(1))), held))


def question_answer(question: Column, evidence: Column, facts: Column, calculations: Column) -> Column:
    """For a question for a fiscal year's net income and a count of years, the fact and the count; null without both."""
    low, asked = F.lower(question), F.regexp_extract(question, REQUESTED_VALUE, 1)
    fact = F.get(F.filter(facts, lambda f: F.lower(f["metric"]).contains("net income") & (f["year"].cast("string") == asked)), F.lit(0))
    first = F.get(F.filter(calculations, lambda c: F.lower(c["type"]) == "count"), F.lit(0))

    def told(f: Column, c: Column, n: Column) -> Column:
        billions = low.contains("billion") & (F.lower(f["scale"]) == "million")
        value = F.when(billions, F.concat(F.lit("$"), F.round(f["value"] / 1000, 1).cast("decimal(30,1)").cast("string"), F.lit(" billion"))).otherwise(f["raw_value"])
        text = F.concat(f["company"], F.lit(" fiscal "), asked, F.lit(" "), F.lower(f["metric"]), F.lit(" was "), value, F.lit(" ["), f["ref"], F.lit("]["), f["evidence"], F.lit("]\nThe table covers "), c["display"], F.lit(" fiscal years ("), F.array_join(n["years"], ", "), F.lit(") ["), c["ref"], F.lit("]["), n["evidence"], F.lit("]\n\nSources:\n"))
        return F.when(f.isNotNull() & n["evidence"].isNotNull(), F.rtrim(F.concat(text, sources_of(F.array_distinct(F.array(f["evidence"], n["evidence"])), evidence))))

    both = let(first, lambda c: let(counted(c, evidence), lambda n: let(fact, lambda f: told(f, c, n))))
    return F.when((asked != "") & low.contains("net income"), both)


def ledger_answer(answer: Column, evidence: Column, facts: Column, calculations: Column) -> Column:
    """The verified facts (with calculations: theirs and totals), the calculations and the sources, headed in the language
    of the answer that they replace."""
    none = F.array().cast("array<string>")
    line = lambda f: F.concat(F.lit("- "), f["company"], F.lit(" FY"), f["year"], F.lit(" | "), f["metric"], F.lit(" = "), f["raw_value"], F.lit(" ["), f["ref"], F.lit("]["), f["evidence"], F.lit("]\n"))
    named = F.flatten(F.transform(calculations, lambda c: F.transform(F.coalesce(c["fact_ids"], none), lambda i: F.upper(i))))
    shown = let(named, lambda n: F.filter(facts, lambda f: (F.size(n) == 0) | F.array_contains(F.array_compact(n), F.upper(f["ref"])) | F.lower(f["metric"]).like("total %")))
    counts = F.filter(F.transform(calculations, lambda c: F.struct(F.lit(1).alias("kind"), c["pos"].alias("pos"), counted(c, evidence)["evidence"].alias("ref"))), lambda x: x["ref"].isNotNull())

    def row(c: Column) -> Column:
        of = F.array_distinct(_in_order(operand_facts(c["fact_ids"], facts), lambda o: o["k"], lambda o: o["f"]["evidence"]))
        ids = let(F.coalesce(of, none), lambda i: F.when(F.size(i) > 0, i).otherwise(F.array_compact(F.array(counted(c, evidence)["evidence"]))))
        return F.concat(F.lit("- "), c["type"], F.lit(": "), c["expression"], F.lit(" = "), c["display"], F.lit(" "), c["scale"], F.lit(" "), c["unit"], F.lit(" ["), c["ref"], F.lit("]"), marks_of(ids), F.lit("\n"))

    def text(s: Column) -> Column:
        cites = F.concat(F.transform(s, lambda f: F.struct(F.lit(0).alias("kind"), f["pos"].alias("pos"), f["evidence"].alias("ref"))), counts)
        source = lambda e: F.concat(F.lit("["), e["ref"], F.lit("] "), e["source_file"], F.lit(" — "), F.when(F.trim(e["section"]) != "", e["section"]).otherwise(e["item"]), F.lit("\n"))
        files = F.flatten(F.transform(F.array_distinct(F.transform(F.array_sort(cites), lambda x: x["ref"])), lambda i: F.array_sort(F.transform(F.filter(evidence, lambda e: e["ref"] == i), source))))
        sums = F.when(F.size(calculations) > 0, F.concat(head("calculations"), F.array_join(F.transform(calculations, row), ""))).otherwise("")
        return F.concat(head("facts"), F.array_join(F.transform(s, line), ""), sums, head("sources"), F.array_join(files, ""))

    english = mostly_english(answer)
    head = lambda k: F.when(english, HEADS[k][0]).otherwise(HEADS[k][1])
    return F.regexp_replace(let(shown, text), r"\s+$", "")


def enforced_rows(rows: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, rung, answer) of each question, whose row has all of it: answer, question, strict, and the arrays evidence,
    facts and calculations, each of structs in order of pos with the columns that `enforced` names. Nothing is shuffled."""
    answer, evidence, facts, calculations = F.coalesce("answer", F.lit("")), F.col("evidence"), F.col("facts"), F.col("calculations")
    question = F.coalesce("question", F.lit(""))
    own = F.transform(evidence, lambda e: F.struct(e["ref"].alias("ref"), e["company"].alias("company"), supporting(e["content"], e["year"]).alias("supported")))
    rung = lambda n, text: F.struct(F.lit(n).alias("n"), text.alias("answer"))

    def wrong_of(text: Column, own: Column) -> Column:
        return issues(text, own, F.transform(calculations, lambda c: c["ref"]), facts)

    def mended(a: Column, own: Column, wrong: Column) -> Column:
        # candidates are audited as answers of their own, with the evidence of their question
        tried = lambda n, text: let(text, lambda t: F.when((F.trim(t) != "") & (F.size(wrong_of(t, own)) == 0), rung(n, t)))
        unsafe = F.transform(wrong, lambda w: F.trim(w["sentence"]))
        only = F.forall(wrong, lambda w: w["code"].isin(SALVAGEABLE))
        cut = F.when(only, let(salvaged(a, unsafe), lambda c: F.when(c != a, c)))
        open_ = F.col("strict") & (F.size(facts) > 0)
        told = open_ & mostly_english(a)
        lines = F.slice(F.array_sort(F.array_distinct(F.transform(wrong, lambda w: F.concat_ws(": ", w["code"], F.nullif(w["sentence"], F.lit("")))))), 1, MOST_ISSUES)
        details = F.array_join(F.transform(lines, lambda d: F.concat(F.lit("- "), d)), "\n")
        return F.coalesce(
            tried(1, cut), tried(2, F.when(told, calculation_answer(question, evidence, facts, calculations))), tried(3, F.when(told, question_answer(question, evidence, facts, calculations))),
            F.when(open_, rung(4, ledger_answer(a, evidence, facts, calculations))),
            F.when(~F.col("strict"), rung(5, F.concat(F.regexp_replace(a, r"\s+$", ""), F.lit(WARNING), details))),
            F.when(F.col("strict"), rung(6, F.concat(F.lit(BLOCKED[0]), details, F.lit(BLOCKED[1])))),
        )

    best = let(answer, lambda a: let(own, lambda o: let(wrong_of(a, o), lambda w: F.when(F.size(w) == 0, rung(0, a)).otherwise(mended(a, o, w)))))
    return rows.select(qid, best.alias("best")).select(qid, F.get(F.array(*[F.lit(r) for r in RUNGS]), F.col("best.n")).alias("rung"), F.col("best.answer").alias("answer"))


def enforced(answers: DataFrame, evidence: DataFrame, facts: DataFrame, calculations: DataFrame, strict: Column | bool = True, qid: str = "qid") -> DataFrame:
    """(qid, rung, answer) of each question, rung one of RUNGS.

    answers: qid, answer, question (and what strict reads); evidence: qid, ref, pos, company, year, content, source_file,
    section, item; facts: qid, ref, pos, evidence, company, year, metric, raw_value, value, scale; calculations: qid, ref,
    pos, type, expression, display, scale, unit, fact_ids. Null answers count as empty.

    A valid answer stays. Of an invalid one, first come its lines without the unsafe ones, if nothing but such lines is
    wrong; then, where strict and there are facts, and the answer is in English, the first calculation and the fact that
    the question asks for; all these must be valid themselves, and are audited in their row. What is left gets the ledger,
    or without facts is blocked; where not strict, it stays with a warning. Each table is shuffled once, by question.
    """
    rows = answers.select(qid, "answer", "question", (F.lit(strict) if isinstance(strict, bool) else strict).alias("strict"))
    for name, df, columns in (("evidence", evidence, EVIDENCE), ("facts", facts, FACT), ("calculations", calculations, CALCULATION)):
        rows = rows.join(df.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)), qid, "left")
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return enforced_rows(rows, qid)
