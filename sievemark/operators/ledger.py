"""Evidence ledger: fact merge, operand binding, exact-decimal calculations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT = "decimal(20,6)"

# The operators, and other names of some.
OPERATORS = ["NONE", "SUM", "DIFFERENCE", "RATIO", "PERCENT_CHANGE", "MARGIN", "AVERAGE", "CAGR", "COUNT"]
ALIASES = {"ADD": "SUM", "SUBTRACT": "DIFFERENCE", "DIVIDE": "RATIO", "PERCENT_OF_TOTAL": "MARGIN"}


def operator_name(name: Column) -> Column:
    """The operator that a name means; NONE for null, blank and unknown ones."""
    up = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), up), up)
    return F.when(said.isin(OPERATORS), said).otherwise("NONE")


def difference(a: Column, b: Column) -> Column:
    return a - b


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for a zero denominator."""
    return F.try_divide(a.cast(FACT), b.cast(FACT))


def percent_change(old: Column, new: Column) -> Column:
    return F.try_divide((new - old).cast(FACT), old.cast(FACT)) * 100


def margin(part: Column, total: Column) -> Column:
    return ratio(part, total) * 100


def cagr(start: Column, end: Column, periods: Column) -> Column:
    """Null unless start > 0, end >= 0 and periods > 0."""
    fits = (start > 0) & (end >= 0) & (periods > 0)
    return F.when(fits, (F.pow(end.cast("double") / start.cast("double"), 1.0 / periods) - 1) * 100)


def shaped(value: Column, precision: int, factor: int = 1) -> Column:
    """A result in its output scale, rounded half up to 0-8 places, without trailing zeros, as text."""
    p = max(0, min(8, precision))
    text = F.round(value.cast("decimal(38,10)") / F.lit(factor).cast("decimal(10,0)"), p).cast(f"decimal(38,{p})").cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def series_change(facts: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change and percent change to the previous row of each series that has one."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return facts.withColumn("previous", before).where("previous is not null").withColumns({"change": F.col(value) - F.col("previous"), "percent_change": percent_change(F.col("previous"), F.col(value))})


def merge_facts(preferred: DataFrame, others: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Preferred facts win over others with the same keys; equal values of what is left count once; ids F1.. by keys."""
    kept = others.join(preferred.select(*keys).distinct(), keys, "left_anti")
    both = preferred.select(*keys, value).unionByName(kept.select(*keys, value)).distinct()
    # numbered within the first key, so that no task orders all facts
    return both.withColumn("fact_id", F.concat(F.lit("F"), F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:], value)).cast("string")))


def bind(operands: DataFrame, facts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """For each operand the one value that its keys name: null if there is none or if several differ, unless exactly
    one of them is marked as an aggregate."""
    j = operands.join(facts, keys, "left")
    own = [c for c in operands.columns]
    out = j.groupBy(*own).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v"), F.count_distinct(F.when(F.col("aggregate"), F.col(value))).alias("_na"), F.min(F.when(F.col("aggregate"), F.col(value))).alias("_a"))
    return out.select(*own, F.when(F.col("_n") == 1, F.col("_v")).when(F.col("_na") == 1, F.col("_a")).alias(value))
