"""Answers that filings give directly: phrases that companies list, ages over the years, changes of wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import let
from ..functions.text import clean_line, named_entities
from .enforcement import listed, marks_of
from .relational import once, small

# Words that make a question one for a list, the lists that descriptions name, and phrases of wording.
COUNTS = ["how many", "count", "多少", "几个", "数量"]
LISTS = ["distinct", "list the", "mentioned", "terms", "items", "列出", "术语", "项目"]
AMOUNTS = ["how much", "amount", "balance", "value", "percentage", "percent", "ratio", "revenue", "net income", "cash balance", "金额", "余额", "百分比", "比率"]
PHRASE_GROUPS = [["actual results", "financial position", "cash generated from operations"], ["financial condition", "results of operations", "cash flows from operations"]]
BIOGRAPHY = r"(?i)\b(age|aged|date\s+of\s+birth|birth\s+year|biograph(?:y|ical)|executive\s+officer|officer\s+age|director\s+age)\b"
AGE = (r"(?is)\b\Q", r"\E\b\s*[,;(\-]?\s*(?:age[d]?\s*)?(1[89]|[2-9]\d)\b")
WORDING_CHANGE = ["wording change", "wording changes", "language change"]
EARLIER, LATER, STABLE = "differ materially from these forward-looking statements", "differ from these forward-looking statements", "the following md&a is intended to assist"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def asks_for_list(question: Column) -> Column:
    """Whether a question asks how many named things there are, not for an amount."""
    return let(F.lower(clean_line(question)), lambda low: _any(low, COUNTS) & _any(low, LISTS) & ~_any(low, AMOUNTS))


def _quoted(phrases: Column) -> Column:
    return F.array_join(F.transform(phrases, lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", ")


def listed_phrases(questions: DataFrame, evidence: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, answer): for questions that ask for a list, the phrases that each company's documents name, with a total.

    Of a company the first of PHRASE_GROUPS counts whose phrases one of its documents has all of; all such documents are
    cited, by year. Companies come in order of their first document. evidence: qid, pos, ref, company, fiscal_year,
    content, source_file, item, section. Which group a document has is found where it is read, so that only numbers and
    labels are grouped.
    """
    asked = once(questions.select(qid, "question"), _asks=asks_for_list(F.col("question"))).where("_asks").select(qid)
    groups = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [F.col("_low").contains(p) for p in g]), i) for i, g in enumerate(PHRASE_GROUPS)]))
    docs = once(evidence.where(F.trim("company") != "").join(asked, qid, "left_semi"), _low=F.lower("content"))
    docs = docs.select(qid, "pos", "ref", F.upper("company").alias("company"), "fiscal_year", "source_file", F.when(F.trim("item") == "", F.col("section")).otherwise(F.col("item")).alias("place"), groups.alias("groups"))
    source = F.concat(F.lit("["), "ref", F.lit("] "), "source_file", F.lit(" — "), "place").alias("line")
    own = F.array_sort(F.collect_list(F.when(F.size("groups") > 0, F.struct("fiscal_year", "pos", "ref", source, "groups")))).alias("docs")
    of = docs.groupBy(qid, "company").agg(F.min("pos").alias("first"), F.min(F.array_min("groups")).alias("group"), own).where("group is not null")
    each = once(of, cited=F.filter("docs", lambda d: F.array_contains(d["groups"], F.col("group"))))
    names = F.array(*[F.array(*[F.lit(p) for p in g]) for g in PHRASE_GROUPS])
    said = F.get(names, F.col("group"))
    line = F.concat("company", F.lit(": "), F.size(said).cast("string"), F.lit(" distinct items — "), _quoted(said), F.lit(" "), marks_of(F.array_distinct("cited.ref")), F.lit("\n")).alias("line")
    placed = F.transform("cited", lambda d: F.struct(F.col("first"), d["fiscal_year"].alias("fiscal_year"), d["pos"].alias("pos"), d["ref"].alias("ref"), d["line"].alias("line"))).alias("placed")
    whole = each.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("first", line, "group", placed))).alias("each"))
    whole = once(whole, placed=F.array_sort(F.flatten("each.placed")), all=F.array_distinct(F.flatten(F.transform("each.group", lambda g: F.get(names, g)))))
    whole = once(whole, all_refs=F.array_distinct("placed.ref"))
    # of a document under several companies the first place counts
    sources = F.transform("all_refs", lambda r: F.get(F.col("placed.line"), F.array_position("placed.ref", r).cast("int") - 1))
    total = F.when(F.size("each") > 1, F.concat(F.lit("Total across all companies: "), F.size("all").cast("string"), F.lit(" distinct terms — "), _quoted(F.col("all")), F.lit(" "), marks_of(F.col("all_refs")), F.lit("\n"))).otherwise("")
    return whole.select(qid, F.concat(F.array_join("each.line", ""), total, F.lit("\nSources:\n"), F.array_join(sources, "\n")).alias("answer"))


def ages(questions: DataFrame, evidence: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, entity, k, fiscal_year, age, before, pos, ref): what documents say of the age of the first name in a question
    on biographies of which two years or more say one; `before` is the year earlier's in the list, null for the first.

    Names are joined to the documents of their question only, and of a year the first document counts. questions: qid,
    question; evidence: qid, pos, ref, fiscal_year, content.
    """
    names = questions.where(F.col("question").rlike(BIOGRAPHY)).select(qid, F.posexplode(named_entities(F.col("question"))).alias("k", "entity"))
    said = evidence.where(F.coalesce(F.trim("fiscal_year"), F.lit("")) != "").join(small(names), qid)
    age = F.call_function("regexp_extract", F.coalesce("content", F.lit("")), F.concat(F.lit(AGE[0]), "entity", F.lit(AGE[1])), F.lit(1))
    found = said.select(qid, "k", "entity", "fiscal_year", "pos", "ref", age.alias("age")).where("age <> ''")
    first = found.groupBy(qid, "k", "entity", "fiscal_year").agg(F.min(F.struct("pos", "ref", F.col("age").cast("int").alias("age"))).alias("s"))
    enough = first.groupBy(qid, "k").agg(F.count("*").alias("n")).where("n > 1").groupBy(qid).agg(F.min("k").alias("k"))
    before = F.lag("age").over(Window.partitionBy(qid).orderBy("fiscal_year"))
    return first.join(enough, [qid, "k"]).select(qid, "entity", "fiscal_year", "s.age", "s.pos", "s.ref").withColumn("before", before)


def age_answers(questions: DataFrame, evidence: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, answer): the ages in order of years with the change from the first to the second, and the sources; in
    Chinese for a question with Chinese characters. evidence as for ages, with source_file, item and section."""
    each = ages(questions, evidence, qid).join(questions.select(qid, F.col("question").rlike("[㐀-鿿]").alias("zh")), qid)
    w = Window.partitionBy(qid).orderBy("fiscal_year")
    each = each.withColumns({"i": F.row_number().over(w), "from": F.lag("fiscal_year").over(w), "gap": F.col("age") - F.col("before")})
    size = F.abs("gap").cast("string")
    change = F.when(F.col("i") == 2, F.concat(F.lit(", "), F.when(F.col("gap") >= 0, "an increase of ").otherwise("a decrease of "), size, F.when(F.abs("gap") == 1, " year").otherwise(" years"), F.lit(" from FY"), "from")).otherwise("")
    english = F.concat(F.lit("In FY"), "fiscal_year", F.lit(", "), "entity", F.lit(" was "), F.col("age").cast("string"), F.lit(" years old ["), "ref", F.lit("]"), change, F.lit("."))
    chinese = F.concat("fiscal_year", F.lit(" 财年，"), "entity", F.lit("为 "), F.col("age").cast("string"), F.lit(" 岁 ["), "ref", F.lit("]。"))
    tail = F.when(F.col("zh") & (F.col("i") == 2), F.concat(F.lit(" 相比 "), "from", F.lit(" 财年，"), "fiscal_year", F.lit(" 财年"), F.when(F.col("gap") >= 0, "增加 ").otherwise("减少 "), size, F.lit(" 岁。")))
    files = each.join(evidence.select(qid, "pos", "ref", "source_file", "item", "section"), [qid, "pos", "ref"])
    source = F.concat(F.lit("["), "ref", F.lit("] "), "source_file", F.lit(" — "), "item", F.lit(" "), "section")
    out = files.groupBy(qid).agg(F.array_join(listed("i", F.when(F.col("zh"), chinese).otherwise(english)), " ").alias("told"), F.max(tail).alias("tail"), F.array_join(listed("i", source), "\n").alias("sources"))
    return out.select(qid, F.rtrim(F.concat("told", F.coalesce("tail", F.lit("")), F.lit("\n\nSources:\n"), "sources")).alias("answer"))


def wording_changes(questions: DataFrame, evidence: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, changed_earlier, changed_later, stable_earlier, stable_later): the four documents (refs) that an answer on
    changed wording compares, for questions that ask for it and have all four.

    The first document with EARLIER; the first of its company and another year with LATER; of the first other company
    with two documents or more that have STABLE, the first and the last by year.
    """
    q = F.lower(clean_line(F.col("question")))
    asked = questions.where(q.contains("forward-looking") & _any(q, WORDING_CHANGE) & q.contains("cash generated from operations")).select(qid)
    low = F.lower("content")
    has = evidence.join(asked, qid, "left_semi").select(qid, "pos", "ref", F.upper("company").alias("company"), "fiscal_year", low.contains(EARLIER).alias("e"), low.contains(LATER).alias("l"), low.contains(STABLE).alias("s")).where("e or l or s")
    earlier = has.where("e").groupBy(qid).agg(F.min(F.struct("pos", "ref", "company", "fiscal_year")).alias("a"))
    j = has.join(earlier, qid)
    later = j.where("l and company = a.company and fiscal_year <> a.fiscal_year").groupBy(qid).agg(F.min(F.struct("pos", "ref")).alias("b"))
    stable = j.where("s and company <> a.company").groupBy(qid, "company").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.min(F.struct("fiscal_year", "pos", "ref")).alias("c"), F.max(F.struct("fiscal_year", "pos", "ref")).alias("d")).where("n > 1")
    stable = stable.groupBy(qid).agg(F.min(F.struct("first", "c", "d")).alias("x"))
    return earlier.join(later, qid).join(stable, qid).select(qid, F.col("a.ref").alias("changed_earlier"), F.col("b.ref").alias("changed_later"), F.col("x.c.ref").alias("stable_earlier"), F.col("x.d.ref").alias("stable_later"))
