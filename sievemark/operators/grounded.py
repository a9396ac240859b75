"""Facts that need no model: rows of tables and sentences that a question names, and operands found in the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X
from .ledger import FACT
from .relational import once

# What a question may take for granted, what a sentence says of combined cash, and rows that are looked for.
PREMISE = r"(?i)net income for fiscal(?: year)?\s*(20\d{2})\s+is\s+\$?([\d,.]+)\s+(million|billion)"
COMBINED_CASH = r"(?is)(cash\s*,?\s*cash equivalents\s*,?\s*(?:and\s+)?short-term investments)(?:\s+\w+){0,10}\s+\$?([\d,.]+)\s+(million|billion)"
CASH_ROWS = ["cash and cash equivalents", "short-term investments", "total cash, cash equivalents, and short-term investments"]
COMBINED_NAME = "Total cash, cash equivalents, and short-term investments"
ROW_NUMBER = r"\(?\d[\d,]*(?:\.\d+)?\)?"
NUMBER = r"[-+]?\d[\d,]*(?:\.[ \t]*\d+)?"
#: How far the nearest row may be from the premise, characters around a quoted number, and how far its line may reach.
TOLERANCE, AROUND, LINE = "0.08", 220, 500


def decimal_of(text: Column) -> Column:
    """A number as written in a row: commas dropped, in brackets negative; null for what isn't one."""
    bare = F.regexp_replace(F.trim(text), "[^0-9+.-]", "").try_cast(FACT)
    return F.when(F.trim(text).rlike(r"^\(.*\)$") & (bare > 0), -bare).otherwise(bare)


def document_scale(content: Column) -> Column:
    """The scale that a document's text states for its tables; millions where it states none."""
    low = F.lower(content)
    return F.when(low.contains("in billions"), "billion").when(low.contains("in thousands"), "thousand").otherwise("million")


def table_rows(evidence: DataFrame, qid: str = "qid", wanted: Column | None = None) -> DataFrame:
    """evidence with a row for each row of its tables: k (its place), label, values (its numbers in order), quote. With
    wanted, a condition on the label, numbers are read only in the rows that meet it."""
    each = once(evidence, _rows=A.table_rows(F.col("content"))).select(*evidence.columns, F.posexplode("_rows").alias("k", "quote"))
    numbers = F.filter(F.transform(F.regexp_extract_all(F.regexp_extract("quote", A.TABLE_ROW, 2), F.lit(ROW_NUMBER), F.lit(0)), decimal_of), lambda v: v.isNotNull())
    labelled = once(each, label=X.clean_line(F.regexp_extract("quote", A.TABLE_ROW, 1)))
    return (labelled.where(wanted) if wanted is not None else labelled).withColumn("values", numbers)


def _shown(value: Column, scale: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.lit("$"), plain, F.lit(" "), scale)


_FACT = ["place", "ref", "company", "fiscal_year", "metric", "value", "scale", "quote"]


def cash_facts(questions: DataFrame, evidence: DataFrame, qid: str = "qid") -> DataFrame:
    """Facts for questions on total cash and short-term investments: of each document the first row of each of CASH_ROWS
    (no fact where that has no number), and the first sentence on them together."""
    low = F.lower(X.clean_line(F.col("question")))
    asked = questions.where(low.contains("total cash") & low.contains("short-term investments")).select(qid)
    docs = evidence.join(asked, qid, "left_semi")
    which = F.array_position(F.array(*[F.lit(c) for c in CASH_ROWS]), F.lower("label")).cast("int")
    rows = table_rows(docs, qid, F.lower("label").isin(CASH_ROWS)).withColumn("which", which)
    first = once(rows.withColumn("_n", F.row_number().over(Window.partitionBy(qid, "ref", "which").orderBy("k"))).where("_n = 1"), values=F.col("values"), scale=document_scale(F.col("content"))).where("size(values) > 0")
    told = first.select(qid, F.struct("pos", "which").alias("place"), "ref", "company", "fiscal_year", F.col("label").alias("metric"), F.get("values", F.lit(0)).alias("value"), "scale", "quote")
    said = docs.where(F.lower("content").contains("short-term investments"))
    said = once(said, _said=F.regexp_extract("content", COMBINED_CASH, 0)).where("_said <> ''")
    said = once(said, _value=decimal_of(F.regexp_extract("_said", COMBINED_CASH, 2))).where("_value is not null")
    said = said.select(qid, F.struct("pos", F.lit(len(CASH_ROWS) + 1).alias("which")).alias("place"), "ref", "company", "fiscal_year", F.lit(COMBINED_NAME).alias("metric"), F.col("_value").alias("value"), F.lower(F.regexp_extract("_said", COMBINED_CASH, 3)).alias("scale"), X.clean_line(F.col("_said")).alias("quote"))
    return told.unionByName(said)


def premises(questions: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, year, stated): the net income that a question takes for granted, in units."""
    part = lambda g: F.regexp_extract("question", PREMISE, g)
    found = questions.select(qid, part(1).alias("year"), decimal_of(part(2)).alias("v"), F.lower(part(3)).alias("s")).where("year <> '' and v is not null")
    return found.select(qid, "year", (F.col("v") * X.scale_factor(F.col("s"))).cast("decimal(38,6)").alias("stated"))


def nearest(rows: DataFrame, wanted: DataFrame, value: str, target: str, tolerance: str = TOLERANCE, bucket: int = 0, qid: str = "qid") -> DataFrame:
    """The row of each question whose value lies nearest to the question's target, if within the share `tolerance` of it;
    of equal distances the first by place.

    wanted: qid, target, one row a question. Only rows whose value lies within the tolerance are joined: both are dealt
    by magnitude first (the power of two of the value; the target's and its two neighbours), so that a question with many
    rows meets few of them, and of these the nearest is a least value by question.
    """
    power = lambda c: F.floor(F.log2(F.greatest(F.abs(c.cast("double")), F.lit(1e-6)))).cast("int")
    t = wanted.withColumn("_m", F.explode(F.array(*[power(F.col(target)) + i for i in (-1, 0, 1)])))
    near = rows.withColumn("_m", power(F.col(value))).join(t, [qid, "_m"]).where("_m is not null")
    gap = F.abs(F.col(value) - F.col(target))
    within = near.where(gap <= F.col(target) * F.lit(tolerance).cast("decimal(4,2)"))
    best = within.withColumn("_n", F.row_number().over(Window.partitionBy(qid).orderBy(gap, "place")))
    return best.where("_n = 1").drop("_n", "_m")


def premise_facts(questions: DataFrame, evidence: DataFrame, qid: str = "qid") -> DataFrame:
    """Two facts for a question that takes a net income for granted: the row of net income (none of noncontrolling
    interests) whose first value is nearest to it, within the tolerance, gives that year's and the year before's."""
    p = premises(questions, qid)
    income = (A.metric_name(F.col("label")) == "net income") & ~F.lower("label").contains("noncontrolling")
    rows = table_rows(evidence.join(p.select(qid), qid, "left_semi"), qid, income)
    rows = once(rows, values=F.col("values"), scale=document_scale(F.col("content"))).where(F.size("values") >= 2)
    rows = rows.withColumns({"base": (F.get("values", F.lit(0)) * X.scale_factor(F.col("scale"))).cast("decimal(38,6)"), "place": F.struct("pos", "k")})
    best = nearest(rows, p, "base", "stated", qid=qid)
    both = best.select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"))
    year = (F.col("year").cast("int") - F.col("i")).cast("string")
    return both.select(qid, F.struct("pos", F.lit(100).alias("which")).alias("place"), "ref", "company", year.alias("fiscal_year"), F.col("label").alias("metric"), F.get("values", F.col("i")).alias("value"), "scale", "quote", "i").withColumn("place", F.struct(F.col("place.pos").alias("pos"), (F.col("place.which") + F.col("i")).alias("which"))).drop("i")


def numbered(facts: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, fact_id, ref, company, fiscal_year, metric, raw_value, value, scale): facts in order, of equal ones (name of
    the metric, value, company, year) the first."""
    same = Window.partitionBy(qid, "_name", "value", F.upper("company"), "fiscal_year").orderBy("place")
    first = once(facts, _name=A.metric_name(F.col("metric"))).withColumn("_n", F.row_number().over(same)).where("_n = 1")
    number = F.concat(F.lit("F"), F.row_number().over(Window.partitionBy(qid).orderBy("place")).cast("string"))
    raw = F.col("raw_value") if "raw_value" in facts.columns else _shown(F.col("value"), F.col("scale"))
    return first.select(qid, number.alias("fact_id"), "ref", "company", "fiscal_year", "metric", raw.alias("raw_value"), "value", "scale", "quote")


def deterministic_facts(questions: DataFrame, evidence: DataFrame, qid: str = "qid") -> DataFrame:
    """Facts that the question's own words ask for, without a model. questions: qid, question; evidence: qid, pos, ref,
    company, fiscal_year (string), content."""
    cash = cash_facts(questions, evidence, qid).withColumn("place", F.struct(F.lit(0).alias("kind"), "place"))
    premise = premise_facts(questions, evidence, qid).withColumn("place", F.struct(F.lit(1).alias("kind"), "place"))
    return numbered(cash.unionByName(premise), qid)


def number_quote(content: Column, start: Column, length: Column) -> Column:
    """What is quoted of a text for the number at `start` (from 1): its line, as far as that reaches at most LINE
    characters on that side, else AROUND characters."""
    before = F.substring(content, F.lit(1), start - 1)
    line_start = F.length(before) - F.length(F.substring_index(before, "\n", -1))  # 0: no line break before
    a = F.when((line_start > 0) & (start - 1 - (line_start - 1) <= LINE), line_start + 1).otherwise(F.greatest(F.lit(1), start - AROUND))
    end = start + length  # the first character after the number
    line_end = F.call_function("locate", F.lit("\n"), content, end)
    b = F.when((line_end > 0) & (line_end - end <= LINE), line_end).otherwise(F.least(F.length(content) + 1, end + AROUND))
    return F.trim(F.substring(content, a, b - a), F.lit(" \n\t\r"))


def numbers_in(evidence: DataFrame) -> DataFrame:
    """evidence with pieces (the text cut after each of its numbers), written (the numbers as they stand) and numbers (as
    exact decimals): the place of a number is what the pieces up to it are long."""
    pieces, written = (F.regexp_extract_all("content", F.lit(f"(?s)(.*?)({NUMBER})"), F.lit(g)) for g in (0, 2))
    cut = once(evidence, pieces=pieces, written=written)
    return once(cut, numbers=F.transform("written", decimal_of))


def says_metric(metric: Column, value: Column, quote: Column) -> Column:
    """Whether a quote supports the value for the metric: a row with the value is named so; without such a row, the text
    names the metric."""
    rows = F.filter(F.regexp_extract_all(quote, F.lit(A.TABLE_ROW), F.lit(0)), lambda r: F.exists(F.regexp_extract_all(F.regexp_extract(r, A.TABLE_ROW, 2), F.lit(ROW_NUMBER), F.lit(0)), lambda n: decimal_of(n) == value))
    named = lambda rs: F.exists(rs, lambda r: A.metrics_agree(metric, F.regexp_extract(r, A.TABLE_ROW, 1)))
    told = F.lower(quote).contains(A.metric_name(metric)) | A.metrics_agree(metric, quote)
    return A.let(rows, lambda rs: F.when(F.size(rs) > 0, named(rs)).otherwise(told))


def plan_facts(operands: DataFrame, evidence: DataFrame, qid: str = "qid") -> DataFrame:
    """Facts of a plan's operands that are found in the evidence, numbered.

    operands: qid, plan, pos, operator, task, company, year, metric, raw_value, scale (blank: not said); evidence: qid,
    pos, ref, company, fiscal_year (string), content, tasks (array). An operand without a number or metric, and counts,
    give nothing. First come documents of the operand's task (all, if it names none), then others, which must be of its
    company and year, both named. The first document counts that has the operand's very number, with a quote that says
    its metric. A question's operands are one row, which meets its documents by question; whether a document has an
    operand's number is found in the row, so that rows are dealt by question once and texts are searched once for all
    operands. What is long to compute is computed once a row.
    """
    o = operands.where((F.upper("operator") != "COUNT") & (F.trim("metric") != "")).select(qid, "plan", F.col("pos").alias("at"), "task", F.col("company").alias("c"), F.col("year").alias("y"), "metric", "raw_value", F.col("scale").alias("proposed"))
    o = once(o, number=A.raw_decimal(F.col("raw_value")).cast(FACT)).where("number is not null")
    each = o.groupBy(qid).agg(F.collect_list(F.struct(*[c for c in o.columns if c != qid])).alias("operands"))
    docs = numbers_in(evidence.join(each, qid))

    def fits(x: Column) -> Column:
        own = (x["task"] == "") | F.array_contains("tasks", x["task"])
        of = (x["c"] == "") | (F.upper(x["c"]) == F.upper("company"))
        return F.array_contains("numbers", x["number"]) & of & (own | ((x["c"] != "") & (x["y"] != "") & (x["y"] == F.col("fiscal_year"))))

    met = docs.withColumn("x", F.explode(F.filter("operands", fits))).select(*evidence.columns, "pieces", "written", "numbers", "x.*")
    met = once(met, _i=F.array_position("numbers", F.col("number")).cast("int"))
    met = once(met, _long=F.length(F.element_at("written", F.col("_i"))), _end=F.length(F.array_join(F.slice("pieces", F.lit(1), F.col("_i")), "")))
    met = once(met.drop("pieces", "written", "numbers"), quote=number_quote(F.col("content"), F.col("_end") - F.col("_long") + 1, F.col("_long")))
    met = once(met, _says=says_metric(F.col("metric"), F.col("number"), F.col("quote"))).where("_says")
    tier = F.when((F.col("task") == "") | F.array_contains("tasks", F.col("task")), 0).otherwise(1)
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy(qid, "plan", "at").orderBy(tier, "pos"))).where("_n = 1")
    blank = lambda a, b: F.when(F.trim(a) == "", F.col(b)).otherwise(F.col(a))
    best = once(best.drop("scale"), scale=A.scale_of_fact(F.col("raw_value"), F.col("proposed"), F.col("metric"), F.col("quote"), F.col("content")))
    return numbered(best.select(qid, F.struct("plan", "at").alias("place"), "ref", blank("c", "company").alias("company"), blank("y", "fiscal_year").alias("fiscal_year"), "metric", "raw_value", F.col("number").alias("value"), "scale", "quote"), qid)
