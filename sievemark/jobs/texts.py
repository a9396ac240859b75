"""Queries of the text functions over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .base import query, table


def _in(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: The tokenizers in SQL, for use in other oracles: {0} is the text.
TOK = "list_transform(list_filter(list_transform(regexp_extract_all(lower({0}), '" + X.SEARCH_PATTERN.replace("{", "{{").replace("}", "}}") + "'), lambda t: trim(t, '" + X.STRIPPED.replace("{", "{{").replace("}", "}}") + "')), lambda t: t <> '' AND NOT list_contains(" + _in(X.SEARCH_STOPWORDS) + ", t)), lambda t: replace(t, ',', ''))"
PAPER_TOK = "list_filter(regexp_extract_all(lower({0}), '" + X.PAPER_PATTERN.replace("{", "{{").replace("}", "}}") + "'), lambda t: NOT list_contains(" + _in(X.PAPER_STOPWORDS) + ", t))"
CONTEXT_TOK = "regexp_extract_all({0}, '" + X.CONTEXT_PATTERN.replace("'", "''").replace("{", "{{").replace("}", "}}") + "')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _tokens(name: str, func, sql: str):
    @query(name, f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql.format('text')} AS t FROM documents)")
    def run(spark, sf_dir):
        t = _docs(spark, sf_dir).select("doc_id", func(F.col("text")).alias("t"))
        return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_tokens("tx01_search_tokens", X.search_tokens, TOK)
_tokens("tx02_paper_tokens", X.paper_tokens, PAPER_TOK)
_tokens("tx03_context_tokens", X.context_tokens, CONTEXT_TOK)
_tokens("tx08_qa_tokens", X.qa_tokens, r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))")


@query("tx04_token_estimate", "SELECT doc_id, CAST(greatest(1, c + CAST(round((length(text) - c) / 4.0e0) AS INT)) AS BIGINT) AS estimate FROM (SELECT doc_id, text, length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS c FROM documents)")
def tx04(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.char_token_estimate(F.col("text")).cast("long").alias("estimate"))


@query("tx05_clean_line", r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS clean_md5 FROM documents")
def tx05(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.clean_line(F.col("text"))).alias("clean_md5"))


@query("tx06_truncate", "SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE left(text, 476) || '...' END) AS end_md5, md5(CASE WHEN length(text) <= 800 THEN text ELSE left(text, 480) || chr(10) || '...' || chr(10) || right(text, 320) END) AS middle_md5 FROM documents")
def tx06(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.truncate_end(t, 500)).alias("end_md5"), F.md5(X.truncate_middle(t, 800)).alias("middle_md5"))


@query("tx07_answer_match", "SELECT doc_id, item_id FROM (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.%]+', ' ', 'g')) AS t FROM documents) d JOIN (SELECT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.%]+', ' ', 'g')) AS a FROM benchmark) b ON contains(d.t, b.a) AND b.a <> ''")
def tx07(spark, sf_dir):
    """Documents that contain a benchmark item after normalisation. Items are a stated query set in a broadcast of checked size."""
    from ..operators.relational import contains_join

    docs = _docs(spark, sf_dir).select("doc_id", X.normalized_answer(F.col("text")).alias("t"))
    items = table(spark, sf_dir, "benchmark").select("item_id", X.normalized_answer(F.col("text")).alias("a"))
    return contains_join(docs, items, "doc_id", "t", "item_id", "a")


@query("tx11_item_reference", r"SELECT doc_id, CASE WHEN i = '' THEN '' ELSE 'Item ' || upper(i) END AS item FROM (SELECT doc_id, coalesce(regexp_extract(text, '(?i)\bitem\s+(\d+[a-z]?)\b', 1), '') AS i FROM documents)")
def tx11(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(X.item_reference(F.col("text")), F.lit("")).alias("item"))


_RUNGS = " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for name, words in X.INTENTS)


@query("tx13_intent", f"SELECT conv_id, turn, CASE {_RUNGS} ELSE 'factual_metric' END AS intent FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations WHERE role = 'user')")
def tx13(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", X.intent(F.col("text")).alias("intent"))


@query("tx15_predicates", r"SELECT doc_id, regexp_matches(text, '(?i)(how many|how much|accuracy|f1|bleu|rouge|percent|percentage|number|count|score)') AS numeric_question, regexp_matches(text, '[一-鿿]') AS cjk, regexp_matches(text, '(?i)(cannot answer|no evidence|not available|insufficient)') AS refusal, regexp_matches(text, '\d') AS has_digit FROM documents")
def tx15(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.numeric_question(t).alias("numeric_question"), t.rlike("[一-鿿]").alias("cjk"), t.rlike("(?i)(cannot answer|no evidence|not available|insufficient)").alias("refusal"), t.rlike(r"\d").alias("has_digit"))


@query("tx17_scale", "SELECT o_orderkey, s AS scale, CAST(CAST(CASE s WHEN 'billion' THEN 1000000000 WHEN 'million' THEN 1000000 WHEN 'thousand' THEN 1000 ELSE 1 END AS DECIMAL(12,0)) * CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS in_units FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'billion' WHEN '2-HIGH' THEN 'million' WHEN '3-MEDIUM' THEN 'thousand' ELSE 'unit' END AS s FROM orders)")
def tx17(spark, sf_dir):
    words = F.create_map(*[F.lit(x) for x in ("1-URGENT", "USD Billion", "2-HIGH", "in millions", "3-MEDIUM", "(in thousands)")])
    o = table(spark, sf_dir, "orders").withColumn("scale", X.scale_name(F.try_element_at(words, F.col("o_orderpriority"))))
    return o.select("o_orderkey", "scale", (X.scale_factor(F.col("scale")) * F.col("o_totalprice").cast("decimal(15,2)")).cast("decimal(38,2)").cast("string").alias("in_units"))


@query("tx19_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def tx19(spark, sf_dir):
    noisy = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(X.json_object(noisy), "k bigint")["k"].alias("k"))


@query("tx24_signature", "SELECT doc_id, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source, CAST(n_chars AS VARCHAR), text)) AS signature FROM documents")
def tx24(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", F.col("n_chars").cast("string"), "text"), 256).alias("signature"))


@query("tx10_years", r"SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS years FROM (SELECT doc_id, list_filter(y, lambda v, i: NOT list_contains(y[1:i-1], v)) AS list_distinct_in_order FROM (SELECT doc_id, list_filter(list_filter(regexp_extract_all(text, '\d+'), lambda w: length(w) = 4), lambda v: v >= '2000' AND v <= '2099') AS y FROM documents))")
def tx10(spark, sf_dir):
    years = X.fiscal_years(F.col("text"), 2000, 2099)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(years, lambda y: y.cast("string")), ",").alias("years"))


@query("tx12_entities")
def tx12(spark, sf_dir):
    """Phrases of two to four capitalised words of each document, each once, in order."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(X.named_entities(F.col("text")), "; ").alias("entities"))


@query("ch19_keywords", f"SELECT doc_id, md5(array_to_string(list(term ORDER BY pos), ' ')) AS keywords_md5 FROM (SELECT doc_id, term, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM (SELECT doc_id, term, min(pos) AS pos FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {TOK.format('concat_ws(chr(32), source, text)')} AS t FROM documents)) GROUP BY ALL)) WHERE r <= 80 GROUP BY doc_id")
def ch19(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(X.search_keywords(F.col("source"), F.col("text")), " ")).alias("keywords_md5"))


@query("ch16_chunk_id", "SELECT doc_id, 'chunk_' || substr(sha256(source || ':text:' || CAST(doc_id AS VARCHAR) || ':' || left(text, 500)), 1, 24) AS chunk_id, substr(sha1(source || ':' || CAST(doc_id AS VARCHAR)), 1, 20) AS paper_chunk_id FROM documents")
def ch16(spark, sf_dir):
    ident = F.concat(F.col("source"), F.lit(":text:"), F.col("doc_id").cast("string"), F.lit(":"), F.substring("text", 1, 500))
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("chunk_"), F.substring(F.sha2(ident, 256), 1, 24)).alias("chunk_id"), F.substring(F.sha1(F.concat_ws(":", "source", F.col("doc_id").cast("string"))), 1, 20).alias("paper_chunk_id"))


@query("lx07_or_query", r"SELECT item_id, array_to_string(u[1:16], ' | ') AS q FROM (SELECT item_id, list_filter(t, lambda v, i: NOT list_contains(t[1:i-1], v)) AS u FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark))")
def lx07(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.or_query(F.col("text")).alias("q"))


@query("tx23_calculator", "SELECT o_orderkey, CAST((o_custkey + 7) * 3 - o_orderkey AS VARCHAR) AS result FROM orders")
def tx23(spark, sf_dir):
    from ..functions.calculator import calculated

    text = F.concat(F.lit("("), F.col("o_custkey").cast("string"), F.lit(" + 7)*3 - "), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", calculated(text).alias("result"))
