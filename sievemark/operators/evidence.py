"""Evidence rules: filters by modality and section, support classes, coverage, rescue, selection, verified facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X
from .relational import once

#: Weights of what a complete audit passage says; each group needs all its phrases.
AUDIT_PARTS = [
    (2, ["report of independent registered public accounting firm"]),
    (3, ["opinion on the financial statements"]),
    (3, ["in our opinion", "present fairly"]),
    (4, ["also have audited", "internal control over financial reporting"]),
    (4, ["also in our opinion", "effective internal control"]),
    (1, ["pcaob"]),
    (3, ["pcaob", "standards of the pcaob"]),
    (1, ["required to be independent"]),
]


def soft_modality(asked: Column, modality: Column) -> tuple[Column, Column]:
    """(filter, rank): tables are asked for strictly; text only comes first, as prose is often wrapped in tables."""
    keep = F.when(asked == "table", modality == "table").otherwise(True)
    return keep, F.when(asked == "text", F.when(modality == "text", 0).otherwise(1)).otherwise(0)


def enforce_section(rows: DataFrame, wider: DataFrame, item: str = "item", asked: str = "asked_item", qid: str = "qid", length: str = "length") -> DataFrame:
    """Rows of the requested item; for a query without any, those of a wider search; else its one shortest text row.

    rows, wider: (qid, asked_item, item, modality, pos, length), wider a superset by a larger limit. A blank request
    keeps the rows as they are. Tiers are ranked in one pass, so no query is searched twice.
    """
    first = rows.withColumn("tier", F.when(F.col(asked) == "", 0).when(F.col(item) == F.col(asked), 1))
    second = wider.where((F.col(asked) != "") & (F.col(item) == F.col(asked))).withColumn("tier", F.lit(2))
    third = wider.where((F.col(asked) != "") & (F.col("modality") == "text")).withColumn("tier", F.lit(3))
    own = Window.partitionBy(qid)
    all_ = first.unionByName(second).unionByName(third).where("tier is not null").withColumn("best", F.min("tier").over(own)).where("tier = best")
    n = F.row_number().over(own.orderBy(F.col(length), F.col("pos")))
    return all_.withColumn("n", n).where("tier < 3 or n = 1").drop("best", "n")


def support(company: Column, year: Column, item: Column, scope: tuple[Column, Column, Column], metric: Column, content: Column) -> Column:
    """DIRECT, SCOPE_ONLY or IRRELEVANT: whether a row is of the task's company, year and item (blank ones ask for
    nothing), isn't a regional breakdown, and states a value of its metric."""
    c, y, i = scope
    fits = ((c == "") | (F.upper(c) == F.upper(company))) & ((y == "") | (y == year)) & ((i == "") | (F.lower(i) == F.lower(item))) & (F.trim(content) != "")
    regional = A.any_of(F.lower(content), ["by region", "emea", "latam", "apac"])
    return F.when(~fits | regional, "IRRELEVANT").when((metric != "") & ~A.direct_value(metric, content), "SCOPE_ONLY").otherwise("DIRECT")


def audit_score(content: Column) -> Column:
    """How complete an audit passage is: the weights of the parts that it has."""
    low = F.lower(X.clean_line(content))
    has = lambda phrases: reduce(lambda a, b: a & b, [low.contains(p) for p in phrases])
    return reduce(lambda a, b: a + b, [F.when(has(p), w).otherwise(0) for w, p in AUDIT_PARTS])


def uncovered(tasks: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks for which no row gives direct support."""
    return tasks.join(rows.where("support = 'DIRECT'").select(*keys).distinct(), keys, "left_anti")


def rescue(tasks: DataFrame, rows: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """rows, and for each task that they don't cover its best direct row of the pool; `rescued` tells them apart."""
    missing = uncovered(tasks, rows, keys)
    again = pool.where("support = 'DIRECT'").join(missing.select(*keys), keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")
    best = again.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows.withColumn("rescued", F.lit(False)).unionByName(best.select(*rows.columns).withColumn("rescued", F.lit(True)))


def select_evidence(matches: DataFrame, limit: int, per_task: int, qid: str = "qid", task: str = "task", key: str = "ref") -> DataFrame:
    """(qid, ref, tasks): a round-robin over tasks, the first row of each, then the second, up to `per_task` of each and
    `limit` rows of a query. A row picked for several tasks counts once and carries these tasks only.

    matches: (qid, task, task_pos, ref, pos). The number of a pick among those that bring a new row decides.
    """
    turn = F.row_number().over(Window.partitionBy(qid, task).orderBy("pos"))
    picks = matches.withColumn("turn", turn).where(F.col("turn") <= per_task)
    order = Window.partitionBy(qid).orderBy("turn", "task_pos")
    first = F.row_number().over(Window.partitionBy(qid, key).orderBy("turn", "task_pos")) == 1
    picks = picks.withColumn("new", first.cast("int"))
    picks = picks.withColumn("held", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a pick is made while the rows before it are fewer than the limit
    made = picks.where(F.col("held") - F.col("new") < limit)
    return made.groupBy(qid, key).agg(F.sort_array(F.collect_set(task)).alias("tasks"))


def extraction_subset(docs: DataFrame, limit: int, qid: str = "qid", task: str = "task", key: str = "ref", each: int = 2) -> DataFrame:
    """Up to `limit` rows of a query: two of each task, priority tasks first, then the rest in order.

    docs: (qid, task, priority, task_pos, ref, pos); a row of several tasks has a row for each.
    """
    n = F.row_number().over(Window.partitionBy(qid, task).orderBy("pos"))
    ranked = docs.withColumn("n", n).withColumn("tier", F.when(F.col("n") <= each, F.when(F.col("priority"), 0).otherwise(1)).otherwise(2))
    place = F.struct("tier", F.when(F.col("tier") < 2, F.col("task_pos")).otherwise(0).alias("t"), "pos")
    once = ranked.groupBy(qid, key).agg(F.min(place).alias("place"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy("place"))).where(F.col("rank") <= limit).select(qid, key, "rank")


def verified_facts(claims: DataFrame, evidence: DataFrame, most: int = 40, qid: str = "qid") -> DataFrame:
    """Claims that their evidence bears out, with value, scale and fact_id.

    claims: qid, pos, ref, metric, raw_value, quote, company, fiscal_year, scale (strings; blank: the evidence's). A claim
    stands if its evidence exists and holds the quote, the quote holds the number and says the metric of it, and the
    company is the evidence's. Of equal facts the first counts, and of a query the first `most`.
    """
    j = claims.join(evidence.select(qid, "ref", F.col("content"), F.col("company").alias("_company"), F.col("fiscal_year").cast("string").alias("_year")), [qid, "ref"])
    value = A.raw_decimal(F.col("raw_value"))
    flat = lambda c: X.clean_line(F.col(c))
    company = F.when(F.trim(F.coalesce("company", F.lit(""))) == "", F.col("_company")).otherwise(F.col("company"))
    year = F.when(F.trim(F.coalesce("fiscal_year", F.lit(""))) == "", F.col("_year")).otherwise(F.col("fiscal_year"))
    # what is cheap to refuse is refused first; then the number and the name are made once, for the rows that are left
    j = j.where((F.trim("metric") != "") & ((F.col("_company") == "") | (F.upper(company) == F.upper("_company"))) & value.isNotNull())
    j = once(j, _value=value, _name=A.metric_name(F.col("metric")), _flat=flat("quote")).where((F.col("_flat") != "") & flat("content").contains(F.col("_flat")) & A.has_number(F.col("quote"), F.abs("_value")))
    rows = F.filter(A.table_rows(F.col("quote")), lambda r: A.has_number(F.regexp_extract(r, A.TABLE_ROW, 2), F.abs("_value")))
    in_row = lambda rs: F.exists(rs, lambda r: A.names_agree(F.col("_name"), A.metric_name(F.regexp_extract(r, A.TABLE_ROW, 1))))
    told = F.lower("quote").contains(F.col("_name")) | A.names_agree(F.col("_name"), A.metric_name(F.col("quote")))
    good = j.where(A.let(rows, lambda rs: F.when(F.size(rs) > 0, in_row(rs)).otherwise(told)))
    good = once(good, _scale=A.scale_of_fact(F.col("raw_value"), F.col("scale"), F.col("metric"), F.col("quote"), F.col("content")))
    facts = good.select(qid, "pos", "ref", company.alias("company"), year.alias("fiscal_year"), "metric", F.col("_value").alias("value"), F.col("_scale").alias("scale"), "_name")
    again = F.row_number().over(Window.partitionBy(qid, "_name", "value", F.upper("company"), "fiscal_year").orderBy("pos"))
    first = facts.withColumn("_n", again).where("_n = 1").drop("_n", "_name")
    number = F.row_number().over(Window.partitionBy(qid).orderBy("pos"))
    return first.withColumn("_f", number).where(F.col("_f") <= most).withColumn("fact_id", F.concat(F.lit("F"), F.col("_f").cast("string"))).drop("_f")


def premise_consistent(facts: DataFrame, premises: DataFrame, qid: str = "qid", share: float = 0.08) -> DataFrame:
    """Facts without those on net income that contradict what the question takes for granted.

    premises: qid, year, stated (in units). The net income fact of that year nearest to the stated value must lie within
    `share` of it; then only facts of its metric's wording stay beside other metrics. Else all net income facts go.
    Queries without a premise keep all. facts: qid, fiscal_year, metric, value, scale.
    """
    income = A.metric_name(F.col("metric")) == "net income"
    base = F.col("value") * X.scale_factor(F.col("scale"))
    j = facts.join(premises, qid, "left")
    gap = F.abs(base - F.col("stated"))
    nearest = j.where(income & (F.col("fiscal_year").cast("string") == F.col("year"))).groupBy(qid).agg(F.min(F.struct(gap.cast("double").alias("gap"), F.lower(X.clean_line(F.col("metric"))).alias("wording"), F.col("stated").cast("double").alias("stated"))).alias("best"))
    ok = F.coalesce(F.col("best.gap") <= share * F.col("best.stated"), F.lit(False))
    kept = F.col("stated").isNull() | ~income | (ok & (F.lower(X.clean_line(F.col("metric"))) == F.col("best.wording")))
    return j.join(nearest, qid, "left").where(kept).select(*facts.columns)


def expected_documents(questions: DataFrame, qid: str = "qid", text: str = "text", companies: str = "companies", years: str = "years") -> DataFrame:
    """(qid, source_file): the filings that a question is about.

    A company and a year belong together if they stand within 80 characters, the company first and no other company
    between; for companies without such a year, the year first. Without any such pair, and with one company or one year,
    all combinations count.
    """
    each = questions.select(qid, F.col(text).alias("t"), F.col(companies).alias("cs"), F.col(years).alias("ys"), F.explode(companies).alias("c"), F.col(years).alias("y_")).withColumn("y", F.explode("y_")).drop("y_")
    between = lambda pattern: F.call_function("regexp_extract", F.col("t"), pattern, F.lit(1))

    def near(pattern: Column) -> Column:
        others = F.exists("cs", lambda o: (o != F.col("c")) & F.call_function("regexp_like", between(pattern), F.concat(F.lit(r"(?i)\b"), o, F.lit(r"\b"))))
        return F.call_function("regexp_like", F.col("t"), pattern) & ~others

    forward = near(F.concat(F.lit(r"(?is)\b"), "c", F.lit(r"\b(.{0,80}?)\b(?:FY\s*)?"), "y", F.lit(r"\b")))
    backward = near(F.concat(F.lit(r"(?is)\b(?:FY\s*)?"), "y", F.lit(r"\b(.{0,80}?)\b"), "c", F.lit(r"\b")))
    all_ = each.withColumns({"forward": forward, "backward": backward})
    led = F.bool_or("forward").over(Window.partitionBy(qid, "c"))
    pair = all_.withColumn("pair", F.col("forward") | (~led & F.col("backward")))
    any_ = pair.withColumn("any", F.bool_or("pair").over(Window.partitionBy(qid)))
    kept = (F.size("cs") <= 1) | (F.size("ys") <= 1) | ~F.col("any") | F.col("pair")
    return any_.where(kept).select(qid, F.concat("c", F.lit("_"), "y", F.lit(".html")).alias("source_file")).distinct()


def expected_sections(questions: DataFrame, documents: DataFrame, qid: str = "qid", label: str = "section", question: str = "question") -> DataFrame:
    """(qid, source_file, section): the filing sections that a question's label names.

    Parts of the label that begin with an expected company and a colon name that company's item; where there is one such
    part, only these count. Else the label's item, or the question's, is that of all expected documents.
    """
    parts = questions.select(qid, F.explode(F.split(F.coalesce(label, F.lit("")), "[;；]")).alias("part"))
    own = parts.select(qid, F.upper(F.regexp_extract("part", r"^\s*([A-Za-z][A-Za-z0-9._-]*)\s*[:：]", 1)).alias("company"), A.requested_item(F.col("part")).alias("section"))
    docs = documents.withColumn("company", F.upper(F.regexp_extract("source_file", r"^(.*)_", 1)))
    named = own.where("company <> ''").join(docs, [qid, "company"])
    has = named.select(qid).distinct()
    section = F.coalesce(F.nullif(A.requested_item(F.col(label)), F.lit("")), A.requested_item(F.col(question)))
    common = questions.select(qid, section.alias("section")).join(has, qid, "left_anti").where("section <> ''").join(docs, qid)
    return named.where("section <> ''").select(qid, "source_file", "section").unionByName(common.select(qid, "source_file", "section")).distinct()


def calculation_match(question: Column, expected: Column, kind: Column, result: Column) -> Column:
    """Whether a calculation's result is one of the numbers of question and answer, or is derived from two of them: a
    difference, or a change in percent. result: array of struct(value, percent); null without numbers on a side."""
    gold = A.answer_numbers(F.concat_ws(" ", question, expected))
    plain = F.filter(gold, lambda g: ~g["percent"])
    direct = F.exists(result, lambda r: F.exists(gold, lambda g: (g["percent"] == r["percent"]) & A.numbers_agree(g["value"], r["value"], g["percent"])))
    pairs = F.flatten(F.transform(plain, lambda a, i: F.transform(F.filter(plain, lambda b: b["value"] != a["value"]), lambda b: F.struct(a["value"].alias("a"), b["value"].alias("b")))))
    gap = F.exists(result, lambda r: ~r["percent"] & F.exists(pairs, lambda p: A.numbers_agree(F.abs(p["b"] - p["a"]), F.abs(r["value"]), F.lit(False))))
    change = F.exists(result, lambda r: r["percent"] & F.exists(pairs, lambda p: (p["a"] != 0) & A.numbers_agree((p["b"] - p["a"]) / p["a"] * 100, r["value"], F.lit(True))))
    derived = F.when(kind == "difference", gap).when(kind == "percentage_change", change).otherwise(False)
    return F.when((F.size(gold) > 0) & (F.size(result) > 0), direct | derived)
