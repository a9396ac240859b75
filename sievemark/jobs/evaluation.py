"""Evaluation queries: overlap of documents with their source's first document, event latencies, label reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluate
from .base import query, table
from .texts import TOK


def _turn_pairs(spark, sf_dir) -> DataFrame:
    """Each assistant turn with the user turn before it: the stand-in for expected and predicted answers."""
    m = table(spark, sf_dir, "conversations")
    user = m.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), X.search_tokens(F.col("text")).alias("expected"))
    own = m.where("role = 'assistant'").select("conv_id", "turn", X.search_tokens(F.col("text")).alias("predicted"), F.length("text").alias("chars"))
    return own.join(user, ["conv_id", "turn"]).withColumn("id", F.concat_ws(":", "conv_id", "turn"))


_PAIRS = f"p AS (SELECT a.conv_id || ':' || a.turn AS id, {TOK.format('u.text')} AS e, {TOK.format('a.text')} AS p FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')"
_OVERLAP = f"{_PAIRS}, t AS (SELECT id, unnest(e) AS t, 1 AS x, 0 AS y FROM p UNION ALL SELECT id, unnest(p), 0, 1 FROM p), c AS (SELECT id, sum(least(x, y)) AS c FROM (SELECT id, t, sum(x) AS x, sum(y) AS y FROM t GROUP BY ALL) GROUP BY id), j AS (SELECT p.id, len(e) AS ne, len(p) AS np, coalesce(c, 0) AS c FROM p LEFT JOIN c USING (id))"
_BLANK = "WHEN ne = 0 AND np = 0 THEN 1e0 WHEN ne = 0 OR np = 0 THEN 0e0"


@query("ev01_token_overlap", f"WITH {_OVERLAP} SELECT id, CASE {_BLANK} ELSE round(CAST(c AS DOUBLE) / np, 6) END AS precision, CASE {_BLANK} ELSE round(CAST(c AS DOUBLE) / ne, 6) END AS recall, CASE {_BLANK} ELSE round(2 * CAST(c AS DOUBLE) / (ne + np), 6) END AS f1 FROM j")
def ev01(spark, sf_dir):
    return evaluate.token_overlap(_turn_pairs(spark, sf_dir), "expected", "predicted", "id")


@query("ev02_rouge_l")
def ev02(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("id", F.round(evaluate.rouge_l("expected", "predicted"), 6).alias("rouge_l"))


@query("ev08_first_occurrence", f"SELECT id, md5(string_agg(t, ' ' ORDER BY pos)) AS ordered_md5 FROM (SELECT id, t, min(pos) AS pos FROM (SELECT id, unnest(p) AS t, generate_subscripts(p, 1) AS pos FROM (SELECT a.conv_id || ':' || a.turn AS id, {TOK.format('a.text')} AS p FROM conversations a)) GROUP BY ALL) GROUP BY id")
def ev08(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.array_distinct(X.search_tokens(F.col("text"))).alias("t"))
    return m.where(F.size("t") > 0).select("id", F.md5(F.array_join("t", " ")).alias("ordered_md5"))


@query("ev13_composite", "SELECT doc_id, round(0.5e0 * quality + 0.3e0 * (1 - toxic) + 0.2e0 * CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END, 6) AS composite FROM labels JOIN documents USING (doc_id)")
def ev13(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.round(0.5 * F.col("quality") + 0.3 * (1 - F.col("toxic")) + 0.2 * F.when(F.col("n_chars") > 1000, 1).otherwise(0), 6).alias("composite"))


@query("ev14_means", "SELECT event_type, count(*) AS n, CAST(count(value) AS BIGINT) AS applicable, round(avg(CASE WHEN value > 1 THEN value END), 6) AS mean, count(*) FILTER (WHERE value > 1) AS above FROM (SELECT event_type, round(value, 2) AS value FROM events) GROUP BY event_type")
def ev14(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.round("value", 2).alias("value"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("applicable"), F.round(F.avg(F.when(F.col("value") > 1, F.col("value"))), 6).alias("mean"), F.count_if(F.col("value") > 1).alias("above"))


@query("ev15_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def ev15(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("ev16_report", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS value_mean, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.95), 6) AS value_p95, round(avg(value) FILTER (WHERE user_id % 7 <> 0), 4) AS value_clean, CAST(grouping(event_type) AS INT) AS overall FROM events GROUP BY ROLLUP (event_type)")
def ev16(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("issue", F.col("user_id") % 7 == 0)
    r = evaluate.report(e, "event_type", ["value"], "issue")
    return r.withColumns({c: F.round(c, 4) for c in ("value_mean", "value_clean")})


@query("ev17_context_recall", f"WITH {_OVERLAP} SELECT id, CASE WHEN ne > 0 THEN round(CAST(c AS DOUBLE) / ne, 6) END AS context_recall FROM j")
def ev17(spark, sf_dir):
    p = _turn_pairs(spark, sf_dir)
    o = evaluate.token_overlap(p, "expected", "predicted", "id").join(p.select("id", F.size("expected").alias("ne")), "id")
    return o.select("id", F.when(F.col("ne") > 0, F.col("recall")).alias("context_recall"))


@query("ev18_micro_macro", "SELECT round(CAST(sum(good) AS DOUBLE) / sum(n), 6) AS micro, round(avg(CAST(good AS DOUBLE) / n), 6) AS macro, CAST(count(*) FILTER (WHERE good = n) AS BIGINT) AS perfect FROM (SELECT source, sum(quality) AS good, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)")
def ev18(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    return j.agg(F.round(F.sum("good") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("good") / F.col("n")), 6).alias("macro"), F.count_if(F.col("good") == F.col("n")).alias("perfect"))


@query("ev21_hit_rate", "SELECT lang, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS score, round(avg(quality), 6) AS hit_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def ev21(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    s = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0)
    return j.groupBy("lang").agg(F.round(F.avg(s), 6).alias("score"), F.round(F.avg("quality"), 6).alias("hit_rate"))


@query("ev22_agent_summary", "SELECT event_type, CAST(count(*) AS BIGINT) AS executions, CAST(count(DISTINCT user_id) AS BIGINT) AS users, round(avg(value), 4) AS mean_latency FROM (SELECT DISTINCT user_id, ts, event_type, value FROM events) GROUP BY event_type")
def ev22(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value").distinct()
    return d.groupBy("event_type").agg(F.count("*").alias("executions"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean_latency"))


@query("ev23_count_map", "SELECT source, string_agg(lang || '=' || n, ', ' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def ev23(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "lang", "n"))), ", ").alias("counts"))
