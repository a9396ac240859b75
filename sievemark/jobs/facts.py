"""Ledger queries: facts of nation, year and metric from the order lines, and calculations over them.

Facts of the last, partial year are left out, as growth over it would mean nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ledger
from .base import query, table
from .cases import EV_SQL, evidence

FACTS = (
    "facts AS (SELECT n_name AS company, CAST(year(l_shipdate) AS INT) AS fiscal_year, CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) AS DECIMAL(20,6))) AS DECIMAL(20,6)) AS revenue, CAST(sum(CAST(l_quantity AS DECIMAL(20,6))) AS DECIMAL(20,6)) AS quantity, "
    "count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY ALL)"
)


def facts(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz'2001-01-01'").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_shipdate")
    nations = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("company"))
    each = lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select("company", F.year("l_shipdate").alias("fiscal_year"), (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(12,2)"))).cast(ledger.FACT).alias("r"), F.col("l_quantity").cast(ledger.FACT).alias("q"), "l_orderkey")
    return each.groupBy("company", "fiscal_year").agg(F.sum("r").cast(ledger.FACT).alias("revenue"), F.sum("q").cast(ledger.FACT).alias("quantity"), F.countDistinct("l_orderkey").alias("orders"))


def _d(c):
    return F.round(c, 4).cast("double")


@query("lg08_sum", f"WITH {FACTS} SELECT company, CAST(sum(revenue) AS DOUBLE) AS total FROM facts GROUP BY company")
def lg08(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("company").agg(F.sum("revenue").cast("double").alias("total"))


@query("lg09_difference", f"WITH {FACTS} SELECT company, fiscal_year, CAST(revenue - lag(revenue) OVER w AS DOUBLE) AS change FROM facts WINDOW w AS (PARTITION BY company ORDER BY fiscal_year) QUALIFY change IS NOT NULL")
def lg09(spark, sf_dir):
    return ledger.series_change(facts(spark, sf_dir), ["company"], "fiscal_year", "revenue").select("company", "fiscal_year", F.col("change").cast("double").alias("change"))


@query("lg10_ratio", f"WITH {FACTS} SELECT company, fiscal_year, round(CAST(revenue AS DOUBLE) / CAST(quantity AS DOUBLE), 4) AS ratio FROM facts")
def lg10(spark, sf_dir):
    return facts(spark, sf_dir).select("company", "fiscal_year", _d(ledger.ratio(F.col("revenue"), F.col("quantity"))).alias("ratio"))


@query("lg11_percent_change", f"WITH {FACTS} SELECT company, fiscal_year, round((CAST(revenue AS DOUBLE) - p) / p * 100, 4) AS percent_change FROM (SELECT *, CAST(lag(revenue) OVER (PARTITION BY company ORDER BY fiscal_year) AS DOUBLE) AS p FROM facts) WHERE p IS NOT NULL AND p <> 0")
def lg11(spark, sf_dir):
    return ledger.series_change(facts(spark, sf_dir), ["company"], "fiscal_year", "revenue").select("company", "fiscal_year", _d(F.col("percent_change")).alias("percent_change"))


@query("lg12_margin", f"WITH {FACTS} SELECT company, fiscal_year, round(CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER (PARTITION BY fiscal_year) AS DOUBLE) * 100, 4) AS share FROM facts")
def lg12(spark, sf_dir):
    f = facts(spark, sf_dir)
    total = f.groupBy("fiscal_year").agg(F.sum("revenue").cast(ledger.FACT).alias("total"))
    return f.join(F.broadcast(total), "fiscal_year").select("company", "fiscal_year", _d(ledger.margin(F.col("revenue"), F.col("total"))).alias("share"))


@query("lg13_average", f"WITH {FACTS} SELECT company, round(CAST(sum(revenue) AS DOUBLE) / count(*), 4) AS average FROM facts GROUP BY company")
def lg13(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("company").agg(F.round(F.sum("revenue").cast("double") / F.count("*"), 4).alias("average"))


@query("lg14_cagr", f"WITH {FACTS}, e AS (SELECT company, CAST(arg_min(revenue, fiscal_year) AS DOUBLE) AS a, CAST(arg_max(revenue, fiscal_year) AS DOUBLE) AS b, max(fiscal_year) - min(fiscal_year) AS n FROM facts GROUP BY company) SELECT company, round((pow(b / a, 1e0 / n) - 1) * 100, 4) AS cagr FROM e WHERE n > 0")
def lg14(spark, sf_dir):
    e = facts(spark, sf_dir).groupBy("company").agg(F.min_by("revenue", "fiscal_year").alias("a"), F.max_by("revenue", "fiscal_year").alias("b"), (F.max("fiscal_year") - F.min("fiscal_year")).alias("n"))
    return e.where("n > 0").select("company", F.round(ledger.cagr(F.col("a"), F.col("b"), F.col("n")), 4).alias("cagr"))


@query("lg15_count", f"WITH {FACTS} SELECT company, CAST(count(DISTINCT fiscal_year) AS BIGINT) AS years, bool_and(revenue > 0) AS supported FROM facts GROUP BY company")
def lg15(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("company").agg(F.countDistinct("fiscal_year").alias("years"), F.bool_and(F.col("revenue") > 0).alias("supported"))


@query("lg16_shaping", f"WITH {FACTS} SELECT company, fiscal_year, regexp_replace(CAST(CAST(round(revenue / 1000, 2) AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', '') AS shown FROM (SELECT company, fiscal_year, CAST(revenue AS DECIMAL(38,6)) AS revenue FROM facts)".replace("\\\\", "\\"))
def lg16(spark, sf_dir):
    return facts(spark, sf_dir).select("company", "fiscal_year", ledger.shaped(F.col("revenue"), 2, 1000).alias("shown"))


_CONFLICT = f"{FACTS}, p AS (SELECT company, fiscal_year, revenue AS value FROM facts WHERE fiscal_year % 2 = 0), o AS (SELECT company, fiscal_year, quantity AS value FROM facts UNION ALL SELECT company, fiscal_year, quantity FROM facts)"


@query("lg04_fact_merge", f"WITH {_CONFLICT}, m AS (SELECT * FROM p UNION SELECT o.* FROM o ANTI JOIN p USING (company, fiscal_year)) SELECT company, fiscal_year, CAST(value AS DOUBLE) AS value, 'F' || CAST(row_number() OVER (PARTITION BY company ORDER BY fiscal_year, value) AS VARCHAR) AS fact_id FROM m")
def lg04(spark, sf_dir):
    f = facts(spark, sf_dir)
    preferred = f.where("fiscal_year % 2 = 0").select("company", "fiscal_year", F.col("revenue").alias("value"))
    others = f.select("company", "fiscal_year", F.col("quantity").alias("value"))
    return ledger.merge_facts(preferred, others.unionAll(others), ["company", "fiscal_year"]).withColumn("value", F.col("value").cast("double"))


@query("lg07_binding", f"WITH {FACTS}, f AS (SELECT company, fiscal_year, revenue AS value, false AS agg FROM facts UNION ALL SELECT company, fiscal_year, quantity, fiscal_year % 3 = 0 FROM facts WHERE fiscal_year % 2 = 0) SELECT company, fiscal_year, CAST(CASE WHEN count(DISTINCT value) = 1 THEN min(value) WHEN count(DISTINCT value) FILTER (WHERE agg) = 1 THEN min(value) FILTER (WHERE agg) END AS DOUBLE) AS value FROM f GROUP BY ALL")
def lg07(spark, sf_dir):
    f = facts(spark, sf_dir)
    rows = f.select("company", "fiscal_year", F.col("revenue").alias("value"), F.lit(False).alias("aggregate")).unionByName(f.where("fiscal_year % 2 = 0").select("company", "fiscal_year", F.col("quantity").alias("value"), (F.col("fiscal_year") % 3 == 0).alias("aggregate")))
    return ledger.bind(f.select("company", "fiscal_year"), rows, ["company", "fiscal_year"]).withColumn("value", F.col("value").cast("double"))


@query("lg18_missing", f"WITH {FACTS} SELECT n_name AS company, y AS fiscal_year FROM nation CROSS JOIN (SELECT CAST(unnest(range(1995, 2003)) AS INT) AS y) t WHERE NOT EXISTS (SELECT 1 FROM facts WHERE company = n_name AND fiscal_year = y)")
def lg18(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.col("n_name").alias("company"), F.explode(F.sequence(F.lit(1995), F.lit(2002))).alias("fiscal_year"))
    return wanted.join(facts(spark, sf_dir), ["company", "fiscal_year"], "left_anti")


@query("lg19_rendering", f"WITH {FACTS} SELECT company, md5(string_agg('F' || CAST(r AS VARCHAR) || ': ' || company || ' FY' || CAST(fiscal_year AS VARCHAR) || ' orders = ' || CAST(orders AS VARCHAR), chr(10) ORDER BY fiscal_year)) AS ledger_md5 FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY fiscal_year) AS r FROM facts) GROUP BY company")
def lg19(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("company").orderBy("fiscal_year"))
    line = F.concat(F.lit("F"), F.col("r").cast("string"), F.lit(": "), "company", F.lit(" FY"), F.col("fiscal_year").cast("string"), F.lit(" orders = "), F.col("orders").cast("string"))
    each = facts(spark, sf_dir).withColumn("r", r).select("company", F.struct("fiscal_year", line.alias("line")).alias("s"))
    return each.groupBy("company").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n")).alias("ledger_md5"))


@query("fu23_adjacent_pairs", f"WITH {FACTS} SELECT company, CAST(lag(fiscal_year) OVER (PARTITION BY company ORDER BY fiscal_year) AS INT) AS from_year, fiscal_year AS to_year FROM facts QUALIFY from_year IS NOT NULL")
def fu23(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("from_year", F.lag("fiscal_year").over(Window.partitionBy("company").orderBy("fiscal_year")))
    return f.where("from_year is not null").select("company", "from_year", F.col("fiscal_year").alias("to_year"))


@query("au03_supported_years", f"WITH {EV_SQL}, y AS (SELECT qid, ref, CAST(fiscal_year AS VARCHAR) AS y FROM ev UNION SELECT qid, ref, y FROM (SELECT qid, ref, unnest(regexp_extract_all(content, '\\d+')) AS y FROM ev) WHERE length(y) = 4 AND y >= '2000' AND y <= '2099' UNION SELECT qid, ref, '2031' FROM ev WHERE pos % 2 = 0 UNION SELECT qid, ref, '2019' FROM ev WHERE fault = 3) SELECT qid, ref, array_to_string(list_sort(list(y)), ',') AS years FROM y GROUP BY qid, ref")
def au03(spark, sf_dir):
    """Years of each row of evidence: those of its text (some name 2031), its own, and those of its facts (some of 2019)."""
    from ..operators.audit import supported_years

    ev = evidence(spark, sf_dir).withColumn("key", F.struct("qid", "ref"))
    rows = ev.select("key", F.col("fiscal_year").alias("year"), F.when(F.col("pos") % 2 == 0, F.concat("content", F.lit(" Due in 2031."))).otherwise(F.col("content")).alias("content"))
    found = ev.where("fault = 3").select("key", F.lit(2019).alias("year"))
    return supported_years(rows, found, "key").select("key.qid", "key.ref", F.array_join("years", ",").alias("years"))
