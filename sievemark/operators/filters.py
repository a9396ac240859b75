"""Filters: equality conjunctions, relaxation tiers, preferences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COMPANY_ALIASES, clean_line, named_entities


def equals(**wanted: str | None) -> Column:
    """All named columns equal their values; a blank or missing value is no filter."""
    tests = [F.col(c) == v for c, v in wanted.items() if v not in (None, "")]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def relaxed(df: DataFrame, by: str, tiers: list[Column]) -> DataFrame:
    """For each key the rows of the strictest tier that has any, in one pass, with the tier's number."""
    tier = None
    for n, test in enumerate(tiers):
        tier = F.when(test, n) if tier is None else tier.when(test, n)
    rows = df.withColumn("tier", tier).where("tier is not null")
    return rows.withColumn("_least", F.min("tier").over(Window.partitionBy(by))).where("tier = _least").drop("_least")


def prefer(df: DataFrame, by: str, test: Column) -> DataFrame:
    """Where a key has rows that meet the test, only these; else all of its rows, also those without a key.

    What keys have is counted first, in each task and then together, so that no key's rows meet in one task."""
    has = df.where(test & F.col(by).isNotNull()).select(F.col(by).alias("_by")).distinct()
    rest = df.join(has, F.col(by) == F.col("_by"), "left_anti")
    return df.where(test & F.col(by).isNotNull()).unionByName(rest)


# Phrases by which evidence of a kind is told.
REGION_WORDS = ["by region", "(ucan)", "(emea)", "(latam)", "(apac)", "united states and canada", "europe, middle east", "latin america", "asia-pacific"]
WHOLE_TABLES = ["| total revenues |", "financial results:", "global streaming memberships:", "consolidated performance highlights"]
OPINION_WORDS = ["opinion on the financial statements", "opinion on financial statements"]
DUTY_WORDS = ["our responsibility is to express an opinion", "our responsibility is to express opinions", "auditor's responsibility", "auditor responsibility"]
CONTROL_WORDS = ["maintained effective internal control", "maintains effective internal control", "effective internal control over financial reporting"]
AGE_WORDS = [" age", "aged", "date of birth", "birth year", "officer age", "director age"]


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def called_company(question: Column, aliases: list[tuple[str, str]] = COMPANY_ALIASES) -> Column:
    """The ticker of the first alias, in the table's order, that a question holds; else the empty string."""
    low = F.lower(F.coalesce(question, F.lit("")))
    held = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(t).alias("t")) for a, t in aliases]), lambda x: low.contains(x["a"]))
    return F.coalesce(F.get(held, F.lit(0))["t"], F.lit(""))


def regional_breakdown(content: Column) -> Column:
    """Whether the first table of a text is one of regions: its 900 characters before say so, and the table itself (4500
    characters) isn't one of totals."""
    low = F.lower(F.coalesce(content, F.lit("")))
    at = F.call_function("locate", F.lit("\n\ntable:"), low)
    before = F.substring(low, F.greatest(F.lit(1), at - 900), F.least(F.lit(900), at - 1))
    return (at > 0) & _any(before, REGION_WORDS) & ~_any(F.substring(low, at, F.lit(4500)), WHOLE_TABLES)


def guarantee(content: Column) -> Column:
    low = F.lower(clean_line(content))
    return low.contains("guarantee") | low.contains("indemnif")


def audit_evidence(description: Column, content: Column) -> Column:
    """Whether a text is what an audit task, told by its description, looks for: independence, responsibility (or both),
    a complete opinion with internal control, or an opinion."""
    d, low = F.lower(clean_line(description)), F.lower(clean_line(content))
    opinion = _any(low, OPINION_WORDS) | (low.contains("in our opinion") & low.contains("present fairly"))
    free = low.contains("required to be independent") | (low.contains("public accounting firm") & low.contains("pcaob"))
    duty = _any(low, DUTY_WORDS)
    complete = low.contains("internal control over financial reporting") & _any(low, CONTROL_WORDS) & low.contains("in our opinion")
    both = d.contains("independence") & d.contains("responsibility")
    return F.when(both, free & duty).when(d.contains("independence"), free).when(d.contains("responsibility"), duty).when(_any(d, ["audit opinion", "audit_opinion"]), opinion & complete).otherwise(opinion)


def biography(query: Column, content: Column) -> Column:
    """Whether a text tells the age of a person that a query names; for a query on executive officers that doesn't ask for
    the age of a name, of anyone beside such officers."""
    text, low = F.coalesce(content, F.lit("")), F.lower(clean_line(query))
    names = named_entities(F.coalesce(query, F.lit("")))
    tells = F.exists(names, lambda n: F.call_function("regexp_like", text, F.concat(F.lit(r"(?is)\b\Q"), n, F.lit(r"\E\b\s*[,;(\-]?\s*(?:age[d]?\s*)?(1[89]|[2-9]\d)\b"))))
    anyone = low.contains("executive officer") & F.lower(text).contains("executive officer") & text.rlike(r"(?is)\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\s*[,;(\-]?\s*(?:age[d]?\s*)?(1[89]|[2-9]\d)\b")
    return tells | (~((F.size(names) > 0) & _any(low, AGE_WORDS)) & anyone)
