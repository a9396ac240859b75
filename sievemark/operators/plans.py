"""Retrieval and calculation plans as tables: scopes that a prompt states, tasks that cover them, operands bound to tasks.

tasks: qid, pos, id, query, companies and years (arrays of strings), metric, operation, modality. operands: qid, plan,
operator, pos, role, task (the id that it is bound to), company, year, metric, with blank strings for what isn't said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line, search_tokens
from .relational import checkpointed, once, small

# Patterns and words that plans are made by, and how far a year may stand from its company.
TOKEN = r"(?<![A-Z0-9-])([A-Z]{1,5}(?:-[A-Z])?)(?![A-Z0-9-])"
YEAR = r"(?<!\d)20(?:22|23|24)(?!\d)"
TABLE_YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
REQUESTED_ITEM = r"(?i)\bitem\s+(\d+[A-Z]?)\b"
PREMISE = r"(?is)\$?[\d,.]+\s+(?:million|billion).{0,100}\b(?:increase|decrease|difference|change)\b"
DATASET_SCOPE = r"(?is)\s*dataset\s+retrieval\s+scope\s*\(metadata\s+only\)\s*:.*$"
BIOGRAPHY = r"(?i)\b(age|aged|date\s+of\s+birth|birth\s+year|biograph(?:y|ical)|executive\s+officer|officer\s+age|director\s+age)\b"
ASKS_REFERENCE = ["referenced table", "referenced note", "references to financial", "table references", "table note reference", "table or note reference", "segment table or note", "additional information", "additional segment detail", "instead of narrative"]
REFERENCE_TARGET = ["reportable segment", "segment detail", "sales data", "sales revenue", "sales driver"]
PERCENT_WORDS = ["percentage change", "percent change", "percentage growth", "percent growth", "growth rate", "what percentage", "by what percent", "% change", "百分比", "百分率", "增长率", "增幅"]
CAGR_WORDS = ["compound annual growth rate", "compound annual rate", "annualized growth rate", "cagr", "复合年增长率", "年复合增长率"]
COUNT_WORDS = ["fiscal years covered", "years covered", "table header years", "header fiscal years"]
NEAR = 40
FALLBACK = "retrieve_1"


def _has(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words: one pattern, so that what makes the text is computed once, not for each."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def stripped(prompt: Column) -> Column:
    """A prompt on one line without the scope that a dataset adds to it."""
    return clean_line(F.regexp_replace(F.coalesce(prompt, F.lit("")), DATASET_SCOPE, ""))


def requested_item(text: Column) -> Column:
    found = F.regexp_extract(clean_line(F.coalesce(text, F.lit(""))), REQUESTED_ITEM, 1)
    return F.when(found == "", "").otherwise(F.concat(F.lit("Item "), F.upper(found)))


def years_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(0)))


def _named(prompts: DataFrame, known: DataFrame, qid: str, prompt: str) -> DataFrame:
    """(qid, company): known companies that a prompt names, each once; its tokens are joined to them by name."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(prompt), F.lit("")), F.lit("(?i)" + TOKEN), F.lit(1))
    each = prompts.select(qid, F.explode(F.array_distinct(F.transform(tokens, F.upper))).alias("company"))
    return each.join(small(known.select("company").distinct()), "company", "left_semi").select(qid, "company")


def mentions(prompt: Column, named: Column) -> Column:
    """Array of struct(k, company, year): the tokens of a prompt that are among its named companies, by their number k.

    The prompt is cut at its tokens, so that a token's place is the sum of the pieces up to it.
    """
    text = F.coalesce(prompt, F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit("(?i)" + TOKEN), F.lit(1))
    pieces = F.regexp_extract_all(text, F.lit("(?is)(.*?)" + TOKEN), F.lit(0))
    own = F.filter(F.transform(tokens, lambda t, k: F.struct(k.alias("k"), F.upper(t).alias("company"), F.length(t).alias("n"))), lambda m: F.array_contains(named, m["company"]))
    end = lambda m: F.length(F.array_join(F.slice(pieces, F.lit(1), m["k"] + 1), ""))

    def year(m: Column) -> Column:
        at = m["end"] - m["n"]
        after = F.nullif(F.regexp_extract(F.substring(text, m["end"] + 1, F.lit(NEAR)), YEAR, 0), F.lit(""))
        before = F.regexp_extract_all(F.substring(text, F.greatest(at - NEAR, F.lit(0)) + 1, F.least(at, F.lit(NEAR))), F.lit(YEAR), F.lit(0))
        return F.coalesce(after, F.try_element_at(before, F.lit(-1)))

    return F.transform(F.transform(own, lambda m: m.withField("end", end(m))), lambda m: F.struct(m["k"].alias("k"), m["company"].alias("company"), year(m).alias("year")))


def company_mentions(prompts: DataFrame, known: DataFrame, qid: str = "qid", prompt: str = "prompt") -> DataFrame:
    """(qid, k, company, year) of each mention of a known company: the first year within NEAR characters after it, else
    the last within as many before it, else null. known: (company) in upper case."""
    both = prompts.select(qid, F.col(prompt).alias("prompt")).unionByName(_named(prompts, known, qid, prompt), allowMissingColumns=True)
    own = both.groupBy(qid).agg(F.max("prompt").alias("prompt"), F.collect_list("company").alias("named")).where(F.size("named") > 0)
    return own.select(qid, F.explode(mentions(F.col("prompt"), F.col("named"))).alias("x")).select(qid, "x.*")


def scopes(mentions: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, scopes): the company-year pairs that a prompt states, in order of their first mention."""
    once = mentions.where("year is not null").groupBy(qid, "company", "year").agg(F.min("k").alias("k"))
    return once.groupBy(qid).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "company", "year"))), lambda s: F.struct(s["company"].alias("company"), s["year"].alias("year"))).alias("scopes"))


def soft_section(query: Column, metric: Column) -> Column:
    """Whether a task looks for biographies or references to other notes, which stand outside the asked section."""
    said = F.concat_ws(" ", clean_line(query), clean_line(metric))
    low = F.lower(clean_line(said))
    return said.rlike(BIOGRAPHY) | (_has(low, ASKS_REFERENCE) & _has(low, REFERENCE_TARGET))


def in_item(query: Column, metric: Column, operation: Column, item: Column) -> Column:
    """A retrieval's query with the asked item in place of the items that it names, or at its end."""
    named = F.call_function("regexp_replace", query, F.lit(REQUESTED_ITEM), item)
    with_item = F.when(requested_item(named) == "", clean_line(F.concat_ws(" ", named, item))).otherwise(named)
    return F.when((item == "") | (F.lower(operation) != "retrieve") | soft_section(query, metric), query).otherwise(with_item)


def augmented(prompts: DataFrame, tasks: DataFrame, known: DataFrame, discovered: DataFrame, qid: str = "qid") -> DataFrame:
    """The tasks of each plan, made to cover what its prompt states.

    prompts: qid, prompt; known: company; discovered: qid, company (what a search for named entities found, if anything).
    Stated scopes are company-year pairs; where there is none, discovered companies with all years of the prompt. A plan
    with neither scopes nor companies only gets the asked item. Otherwise: a retrieval without a known company is bound
    to the one discovered company; all retrievals to the one company that is hinted at, if it is one; the fallback task
    is replaced by a task for each scope; and each scope that no retrieval covers gets a task (with a premise of an
    amount and a change, covered ones get an anchor task as well).

    What is known of a question (its prompt, tasks, companies) is dealt by question once and is one row, in which its
    tasks are made.
    """
    fields = ["pos", "id", "query", "companies", "years", "metric", "operation", "modality"]
    scoped = tasks.select(qid, "pos", F.explode("companies").alias("c")).select(qid, "pos", F.upper(clean_line(F.col("c"))).alias("company"))
    scoped = scoped.join(small(known.select("company").distinct()), "company", "left_semi")
    parts = [
        prompts.select(qid, F.struct("prompt").alias("asked")), tasks.select(qid, F.struct(*fields).alias("task")), _named(prompts, known, qid, "prompt").withColumnRenamed("company", "name"),
        discovered.where("company <> ''").select(qid, F.col("company").alias("found")), scoped.select(qid, F.col("pos").alias("scoped")),
    ]
    dealt = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    s = dealt.groupBy(qid).agg(
        F.max("asked").alias("asked"), F.sort_array(F.collect_list("task")).alias("tasks"), F.collect_set("name").alias("named"),
        F.sort_array(F.collect_set("found")).alias("discovered"), F.collect_set("scoped").alias("scoped"),
    ).where("asked is not null").select(qid, "asked.prompt", "tasks", "named", "discovered", "scoped")
    stated = F.transform(F.filter(mentions(F.col("prompt"), F.col("named")), lambda m: m["year"].isNotNull()), lambda m: F.struct(m["company"].alias("company"), m["year"].alias("year")))
    s = once(s, stated=F.when(F.size("named") > 0, F.array_distinct(stated)), item=requested_item(F.col("prompt")))
    crossed = F.flatten(F.transform("discovered", lambda c: F.transform(years_in(F.col("prompt")), lambda y: F.struct(c.alias("company"), y.alias("year")))))
    s = once(s, scopes=F.when(F.size("stated") > 0, F.col("stated")).when(F.size("discovered") > 0, crossed).otherwise(F.array().cast("array<struct<company:string,year:string>>")))
    s = once(s, hints=F.array_distinct(F.concat("named", "discovered", F.transform("scopes", lambda x: x["company"]))), bare=F.when(F.size("scopes") > 0, stripped(F.col("prompt"))))

    retrieves = lambda t: F.lower(t["operation"]) == "retrieve"
    falling = lambda t: retrieves(t) & (t["id"] == FALLBACK)
    none = F.array().cast("array<string>")

    def bound(t: Column) -> Column:
        one = F.when(retrieves(t) & (F.size("hints") == 1), F.col("hints"))
        return one.when(retrieves(t) & (F.size("discovered") == 1) & ~F.array_contains("scoped", t["pos"]), F.col("discovered")).otherwise(t["companies"])

    s = once(s, tasks=F.transform("tasks", lambda t: F.struct(*[(bound(t) if f == "companies" else t[f]).alias(f) for f in fields])), falls=(F.size("scopes") > 0) & F.coalesce(F.exists("tasks", falling), F.lit(False)))
    s = once(s, kept=F.filter("tasks", lambda t: ~(F.col("falls") & falling(t))), fallback=F.get(F.filter("tasks", lambda t: t["id"] == FALLBACK), F.lit(0)))
    pairs = lambda t: F.flatten(F.transform(F.coalesce(t["companies"], none), lambda c: F.transform(F.coalesce(t["years"], none), lambda y: F.struct(F.upper(c).alias("company"), y.alias("year")))))
    s = once(s, covered=F.flatten(F.transform(F.filter("kept", retrieves), pairs)), lead=F.when(F.col("falls"), stripped(F.col("fallback.query"))), premise=F.when(F.size("scopes") > 0, F.col("prompt").rlike(PREMISE)))

    def made(x: Column, kind: str, tail: Column, query: str, metric: Column, modality: Column) -> Column:
        values = {"id": F.concat(F.lit(kind), F.lower(x["company"]), F.lit("_"), x["year"], tail), "query": F.concat(x["company"], F.lit(" FY"), x["year"], F.lit(" "), F.col(query)), "companies": F.array(x["company"]), "years": F.array(x["year"]), "metric": metric, "operation": F.lit("retrieve"), "modality": modality}
        return F.struct(*[values[f].alias(f) for f in fields[1:]])

    held = lambda x: F.col("falls") | F.array_contains("covered", x)
    dealt_out = F.when(F.col("falls"), F.transform("scopes", lambda x: made(x, "retrieve_scope_", F.lit(""), "lead", F.col("fallback.metric"), F.col("fallback.modality"))))
    more = F.transform(F.filter("scopes", lambda x: ~held(x) | F.col("premise")), lambda x: made(x, "retrieve_explicit_", F.when(held(x), "_anchor").otherwise(""), "bare", F.lit(""), F.lit("hybrid")))
    own = F.transform("kept", lambda t: F.struct(*[t[f].alias(f) for f in fields[1:]]))
    all_ = F.concat(own, F.coalesce(dealt_out, F.filter(own, lambda t: F.lit(False))), more)
    out = s.select(qid, "item", F.posexplode(all_).alias("i", "t")).select(qid, "item", "i", "t.*")
    query = in_item(F.col("query"), F.col("metric"), F.col("operation"), F.col("item"))
    return out.select(qid, (F.col("i") + 1).alias("pos"), "id", query.alias("query"), "companies", "years", "metric", "operation", "modality")


def covers_operand(operation: Column, companies: Column, years: Column, company: Column, year: Column) -> Column:
    """Whether a task is a retrieval that may hold an operand's company and year; what either leaves open fits."""
    fits = (company == "") | (F.size(companies) == 0) | F.exists(companies, lambda c: F.lower(c) == F.lower(company))
    return (F.lower(operation) == "retrieve") & fits & ((year == "") | (F.size(years) == 0) | F.array_contains(years, year))


def rebound(operands: DataFrame, tasks: DataFrame, qid: str = "qid") -> DataFrame:
    """operands, each bound to a task that covers it: its own if that does, else of those that do the first whose metric
    and query share most words with its metric, else its own still."""
    words = lambda c: F.array_distinct(search_tokens(clean_line(c)))
    first = tasks.groupBy(qid, "id").agg(F.min_by(F.struct("operation", "companies", "years"), "pos").alias("own"))
    keyed = operands.withColumn("_key", F.struct(qid, "plan", "pos"))
    own = keyed.join(first.withColumnRenamed("id", "task"), [qid, "task"], "left")
    kept = F.coalesce(covers_operand(F.col("own.operation"), F.col("own.companies"), F.col("own.years"), F.col("company"), F.col("year")), F.lit(False))
    wrong = own.where(~kept).select("_key", qid, "company", "year", words(F.col("metric")).alias("wanted"))
    other = tasks.select(qid, F.col("pos").alias("place"), "id", "operation", "companies", "years", words(F.concat_ws(" ", "metric", "query")).alias("held"))
    fits = wrong.join(other, qid).where(covers_operand(F.col("operation"), F.col("companies"), F.col("years"), F.col("company"), F.col("year")))
    best = fits.groupBy("_key").agg(F.max_by("id", F.struct(F.size(F.array_intersect("wanted", "held")).alias("n"), (-F.col("place")).alias("p"))).alias("_new"))
    return keyed.join(best, "_key", "left").withColumn("task", F.coalesce("_new", "task")).select(*operands.columns)


def one_to_one(operands: DataFrame, tasks: DataFrame, qid: str = "qid", most_rounds: int = 50) -> DataFrame:
    """(qid, plan, pos, task): operands of a question bound to different tasks by rounds of best mutual choice.

    In each round every operand that is left names the free task that covers it and shares most words with its metric,
    every task the operand that shares most with it; pairs that name each other are bound. Ties go to the smaller place
    and plan. Operands for which no task is left have no row. A round decides the closest pair that is left of every
    question, so rounds are at most as many as a question's operands; pairs that are left are a checkpoint each round.
    """
    words = lambda c: F.array_distinct(search_tokens(clean_line(c)))
    o = operands.select(qid, "plan", "pos", "company", "year", words(F.col("metric")).alias("wanted"))
    t = tasks.select(qid, F.col("pos").alias("place"), "id", "operation", "companies", "years", words(F.concat_ws(" ", "metric", "query")).alias("held"))
    pairs = o.join(t, qid).where(covers_operand(F.col("operation"), F.col("companies"), F.col("years"), F.col("company"), F.col("year")))
    left = checkpointed(pairs.select(qid, "plan", "pos", "place", F.col("id").alias("task"), F.size(F.array_intersect("wanted", "held")).alias("n")))
    rank = F.struct((-F.col("n")).alias("n"), "plan", "pos", "place")
    out = None
    for _ in range(most_rounds):
        own = F.min(rank).over(Window.partitionBy(qid, "plan", "pos"))
        best = F.min(rank).over(Window.partitionBy(qid, "place"))
        now = checkpointed(left.withColumns({"_o": own, "_t": best}).where((F.col("_o") == rank) & (F.col("_t") == rank)).select(qid, "plan", "pos", "place", "task"))
        out = now if out is None else out.unionByName(now)
        left = checkpointed(left.join(now.select(qid, "plan", "pos"), [qid, "plan", "pos"], "left_anti").join(now.select(qid, "place"), [qid, "place"], "left_anti"))
        if left.isEmpty():
            return out.select(qid, "plan", "pos", "task")
    raise RuntimeError(f"bindings did not settle in {most_rounds} rounds")


def requested_operators(prompts: DataFrame, plans: DataFrame, qid: str = "qid") -> DataFrame:
    """plans without changes in percent and compound growth that the prompt doesn't ask for. plans: qid, operator, ..."""
    low = F.lower(stripped(F.col("prompt")))
    asks = prompts.select(qid, _has(low, PERCENT_WORDS).alias("_p"), _has(low, CAGR_WORDS).alias("_c"))
    refused = ((F.col("operator") == "PERCENT_CHANGE") & ~F.col("_p")) | ((F.col("operator") == "CAGR") & ~F.col("_c"))
    return plans.join(asks, qid).where(~refused).drop("_p", "_c")


def trend_plans(tasks: DataFrame, operands: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, plan, start, end, from_year, to_year): a change in percent for each pair of neighbouring years of a series,
    the retrievals of one company, one year and one metric each, unless a plan has it already.

    Years of a series needn't follow each other: its next year is the next that there is a task for.
    """
    fine = (F.lower("operation") == "retrieve") & (F.size("companies") == 1) & (F.size("years") == 1) & (clean_line(F.col("metric")) != "")
    series = tasks.where(fine).select(qid, "pos", "id", F.upper(F.col("companies")[0]).alias("company"), F.lower(clean_line(F.col("metric"))).alias("metric"), F.col("years")[0].alias("year"))
    w = Window.partitionBy(qid, "company", "metric").orderBy("year", "pos")
    pairs = series.select(qid, "company", F.lag("id").over(w).alias("start"), F.col("id").alias("end"), F.lag("year").over(w).alias("from_year"), F.col("year").alias("to_year")).where("start is not null")
    held = operands.where("operator = 'PERCENT_CHANGE'").groupBy(qid, "plan").agg(F.collect_set(F.lower("task")).alias("held"))
    known = pairs.join(held, qid).where(F.array_contains("held", F.lower("start")) & F.array_contains("held", F.lower("end"))).select(qid, "start", "end").distinct()
    name = F.concat(F.lit("calculate_trend_"), F.lower("company"), F.lit("_"), "from_year", F.lit("_"), "to_year")
    return pairs.join(known, [qid, "start", "end"], "left_anti").select(qid, name.alias("plan"), "start", "end", "from_year", "to_year")


def count_plans(tasks: DataFrame, operands: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, plan, task, years): a count of the years that a task on a table's header names, two or more, unless a plan
    counts for it already."""
    said = F.lower(F.concat_ws(" ", clean_line(F.col("metric")), clean_line(F.col("query"))))
    years = F.array_distinct(F.regexp_extract_all("query", F.lit(TABLE_YEAR), F.lit(0)))
    asked = tasks.where(_has(said, COUNT_WORDS)).select(qid, F.col("id").alias("task"), years.alias("years")).where(F.size("years") > 1)
    held = operands.where("operator = 'COUNT'").select(qid, F.lower("task").alias("_t")).distinct()
    return asked.join(held, (asked[qid] == held[qid]) & (F.lower(asked["task"]) == held["_t"]), "left_anti").select(qid, F.concat(F.lit("count_"), "task").alias("plan"), "task", "years")


def fallback_queries(prompts: DataFrame, expanded, most: int = 5, qid: str = "qid") -> DataFrame:
    """(qid, queries): what is searched for without a planner: the prompt, the prompt expanded (a function of a column),
    and the prompt with the usual places of figures; equal ones (in either case) once, the first `most`."""
    bare = F.when(stripped(F.col("prompt")) == "", clean_line(F.col("prompt"))).otherwise(stripped(F.col("prompt")))
    p = prompts.select(qid, bare.alias("p"))
    added = F.array("p", expanded(F.col("p")), F.concat("p", F.lit(" annual report 10-K")), F.concat("p", F.lit(" consolidated financial statements")), F.concat("p", F.lit(" table fiscal year period")))
    lines = F.filter(F.transform(added, clean_line), lambda q: q != "")
    low = F.transform(lines, F.lower)
    once = F.filter(lines, lambda q, i: F.array_position(low, F.lower(q)) == i + 1)
    return p.select(qid, F.slice(once, 1, most).alias("queries"))
