"""Retrieval queries: vector, lexical and hybrid search, fusion, selection.

The vectors that stand in for documents and questions are those of embeddings with the same number; questions are all
benchmark items, vector queries all vectors whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fusion, lexical, relational, vector
from .cases import EV_SQL, Q_SQL, evidence, questions
from .base import query, table
from .texts import TOK

_COS = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9)"

#: Vector branch of the hybrid search in SQL: top 60 of each question.
VEC_SQL = f"vs AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, {_COS} AS score FROM embeddings a JOIN benchmark ON a.vec_id = item_id CROSS JOIN embeddings b WHERE a.vec_id <> b.vec_id), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS vector_rank FROM vs) WHERE vector_rank <= 60)"
_ASKED = f"SELECT item_id AS qid, unnest({TOK.format('text')}) AS term FROM benchmark"


def bm25_sql(asked: str) -> str:
    """CTEs up to bs, the scores; asked: SQL of (qid, term)."""
    return (
        f"d AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS dl FROM d), q AS (SELECT DISTINCT qid, term FROM ({asked})), "
        "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), "
        "bs AS (SELECT qid, doc_id, round(sum(ln(1 + greatest(0e0, (n - df + 0.5e0) / (df + 0.5e0))) * (tf * 2.4e0) / (tf + 1.4e0 * (1 - 0.72e0 + 0.72e0 * dl / greatest(avgdl, 1e0)))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL)"
    )


BM25_SQL = bm25_sql(_ASKED)
#: A document's header is its source and language; those in German stand in for tables. Boosts as the service has them.
_PHRASES = " + ".join(f"CASE WHEN contains(low, '{p}') AND contains(dlow, '{p}') THEN 1 ELSE 0 END" for p in lexical.SERVICE_PHRASES)
BOOST_SQL = f"dh AS (SELECT doc_id, lower(source || ' ' || lang) AS header, lower(text) AS dlow, lang = 'de' AS tab FROM documents), qh AS (SELECT item_id AS qid, {TOK.format('text')} AS terms, lower(text) AS low FROM benchmark), bb AS (SELECT qh.qid, dh.doc_id, coalesce(score, 0) AS score, least(3e0, CASE WHEN tab THEN 0.4e0 ELSE 0e0 END + 0.12e0 * len(list_filter(terms, lambda t: contains(header, t))) + 0.18e0 * ({_PHRASES})) AS boost FROM qh CROSS JOIN dh LEFT JOIN bs ON bs.qid = qh.qid AND bs.doc_id = dh.doc_id)"
LEX_SQL = BM25_SQL + f", {BOOST_SQL}, b AS (SELECT * FROM (SELECT qid, doc_id, round(score + boost, 6) AS bm25_score, row_number() OVER (PARTITION BY qid ORDER BY round(score + boost, 6) DESC, doc_id) AS bm25_rank FROM bb WHERE round(score + boost, 6) > 0) WHERE bm25_rank <= 60)"
RRF_SQL = (
    f"{VEC_SQL}, {LEX_SQL}, f AS (SELECT qid, doc_id, vector_rank, score AS vector_score, bm25_rank, bm25_score, round(coalesce(1e0 / (60 + vector_rank), 0e0) + coalesce(1e0 / (60 + bm25_rank), 0e0), 9) AS rrf FROM v FULL JOIN b USING (qid, doc_id)), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, coalesce(vector_score, 0) DESC, doc_id) AS rank FROM f)"
)


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _hundredth(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def vector_branch(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    asked = _vectors(spark, sf_dir).join(relational.small(items), F.col("vec_id") == F.col("qid")).select("qid", "embedding")
    return vector.knn(_vectors(spark, sf_dir), asked, 60).withColumnRenamed("vec_id", "doc_id")


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", X.search_tokens(F.col("text")).alias("terms"))


def bm25_scores(spark, sf_dir) -> DataFrame:
    return lexical.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _asked(spark, sf_dir))


def lexical_branch(spark, sf_dir, k: int = 60) -> DataFrame:
    """The first k by BM25 and boosts; a boost alone brings a document in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("header"), (F.col("lang") == "de").alias("is_table"))
    boosts = lexical.Boosts(docs, _asked(spark, sf_dir))
    scored = lexical.bm25(docs, _asked(spark, sf_dir), also=boosts.alone(k), first=(k, lexical.MOST))
    return lexical.rank_boosted(boosts.of(scored), k).select("qid", "doc_id", "bm25_rank", "bm25_score")


def hybrid(spark, sf_dir) -> DataFrame:
    return fusion.rrf(vector_branch(spark, sf_dir), lexical_branch(spark, sf_dir))


@query("m1_hybrid_search", f"WITH {RRF_SQL} SELECT qid, doc_id, vector_rank, bm25_rank, rrf, CAST(rank AS BIGINT) AS rank FROM h WHERE rank <= 8")
def m1(spark, sf_dir):
    out = hybrid(spark, sf_dir).where("rank <= 8")
    return out.select("qid", "doc_id", F.col("vector_rank").cast("long").alias("vector_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), "rrf", F.col("rank").cast("long").alias("rank"))


@query("vx01_cosine", f"SELECT a.vec_id, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vx01(spark, sf_dir):
    a, b = _vectors(spark, sf_dir), _vectors(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


@query("vx02_exact_topk", f"SELECT qid, vec_id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 30")
def vx02(spark, sf_dir):
    return vector.knn(_vectors(spark, sf_dir), _hundredth(spark, sf_dir), 30).withColumn("rank", F.col("rank").cast("long"))


@query("vx03_ivf_topk")
def vx03(spark, sf_dir):
    return vector.ivf_knn(_vectors(spark, sf_dir), _hundredth(spark, sf_dir), 10).withColumn("rank", F.col("rank").cast("long"))


@query("vx04_euclidean", "SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vx04(spark, sf_dir):
    a, b = _vectors(spark, sf_dir), _vectors(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vector.euclidean(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("vx05_bonus_rank", f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id, b.label, {_COS} AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 60) SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score + CASE WHEN label = 1 THEN 0.04e0 ELSE 0 END + CASE WHEN label = 2 THEN 0.02e0 ELSE 0 END, 9) DESC, score DESC, vec_id) AS BIGINT) AS vector_rank FROM k")
def vx05(spark, sf_dir):
    near = vector.knn(_vectors(spark, sf_dir), _hundredth(spark, sf_dir), 60).join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    bonus = F.when(F.col("label") == 1, 0.04).otherwise(0.0) + F.when(F.col("label") == 2, 0.02).otherwise(0.0)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(F.col("score") + bonus, 9)), F.desc("score"), "vec_id")
    return near.select("qid", "vec_id", "score", F.row_number().over(w).cast("long").alias("vector_rank"))


@query("vx06_rounding", "SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1e8) AS BIGINT) AS VARCHAR)), ',')) AS literal_md5 FROM embeddings")
def vx06(spark, sf_dir):
    """Components to eight decimals, as whole numbers of the last place."""
    digits = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e8).cast("long").cast("string"))
    return _vectors(spark, sf_dir).select("vec_id", F.md5(F.array_join(digits, ",")).alias("literal_md5"))


@query("vx07_filtered_knn", f"SELECT qid, vec_id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND b.label IN (1, 3, 5))) WHERE rank <= 5")
def vx07(spark, sf_dir):
    return vector.knn(_vectors(spark, sf_dir).where("label in (1, 3, 5)"), _hundredth(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("long"))


@query("lx02_document_frequency", f"WITH {BM25_SQL} SELECT term, CAST(df AS BIGINT) AS df, CAST((SELECT n FROM st) AS BIGINT) AS n, round((SELECT avgdl FROM st), 6) AS avgdl FROM df")
def lx02(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(X.search_tokens(F.col("text")))).alias("term"))
    base = relational.checkpointed(lexical.postings(table(spark, sf_dir, "documents"), "text", "doc_id", terms))
    stats = base.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))
    return base.select(F.explode("hits.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))


@query("lx03_bm25_score", f"WITH {BM25_SQL} SELECT qid, doc_id, score FROM bs")
def lx03(spark, sf_dir):
    return bm25_scores(spark, sf_dir)


@query("lx01_searchable_text", f"WITH {EV_SQL} SELECT qid, ref, md5(concat_ws(' ', content, metric, item, company, CAST(fiscal_year AS VARCHAR), array_to_string(['FY' || CAST(fiscal_year AS VARCHAR), scale], ' '))) AS text_md5 FROM ev")
def lx01(spark, sf_dir):
    e = evidence(spark, sf_dir)
    periods = F.array(F.concat(F.lit("FY"), F.col("fiscal_year").cast("string")), "scale")
    return e.select("qid", "ref", F.md5(lexical.searchable(F.col("content"), F.col("metric"), F.col("item"), F.col("company"), F.col("fiscal_year").cast("string"), periods)).alias("text_md5"))


def _asked_rows(spark, sf_dir) -> DataFrame:
    q = questions(spark, sf_dir).select("qid", "question", "section", X.search_tokens(F.col("question")).alias("terms"))
    return evidence(spark, sf_dir).join(q, "qid")


_ROWS_SQL = f"{EV_SQL}, {Q_SQL}, r AS (SELECT ev.*, lower(question) AS asked, section, {TOK.format('question')} AS terms, lower(content) AS low FROM ev JOIN q USING (qid))"
_SHARED = lambda phrases: " + ".join(f"CASE WHEN contains(asked, '{p}') AND contains(low, '{p}') THEN 1 ELSE 0 END" for p in phrases)


@query("lx04_script_boost", rf"WITH {_ROWS_SQL} SELECT qid, ref, round(CASE WHEN modality = 'table' THEN 0.4e0 ELSE 0e0 END + CASE WHEN contains(lower(section), lower(item)) THEN 0.25e0 ELSE 0e0 END + 0.08e0 * len(list_filter(regexp_extract_all(asked, '\d+(?:,\d{{3}})*(?:\.\d+)?%?'), lambda n: contains(replace(low, ',', ''), replace(n, ',', '')))) + least(0.6e0, 0.12e0 * len(list_filter(list_distinct(terms), lambda t: contains(lower(metric), t)))) + 0.18e0 * ({_SHARED(lexical.SCRIPT_PHRASES)}), 6) AS boost FROM r")
def lx04(spark, sf_dir):
    c = F.col
    boost = lexical.script_boost(c("question"), c("terms"), c("content"), c("metric"), c("modality") == "table", c("item"), c("section"))
    return _asked_rows(spark, sf_dir).select("qid", "ref", F.round(boost, 6).alias("boost"))


@query("lx05_service_boost", f"WITH {_ROWS_SQL} SELECT qid, ref, round(least(3e0, CASE WHEN modality = 'table' THEN 0.4e0 ELSE 0e0 END + 0.12e0 * len(list_filter(terms, lambda t: contains(lower(metric), t))) + 0.18e0 * ({_SHARED(lexical.SERVICE_PHRASES)}) + CASE WHEN contains(low, 'net sales') THEN 1.5e0 ELSE 0e0 END), 6) AS boost FROM r")
def lx05(spark, sf_dir):
    """Boosts of a question that also names two entities, 'Net Sales' and 'Great Lakes'."""
    rows = _asked_rows(spark, sf_dir).withColumn("rid", F.concat_ws(":", "qid", "ref"))
    entities = X.named_entities(F.concat(F.col("question"), F.lit(" (Net Sales, Great Lakes)")))
    hits = F.size(F.filter(entities, lambda e: F.lower("content").contains(F.lower(e))))
    asked, held = lexical.phrases_in(F.col("question"), lexical.SERVICE_PHRASES), lexical.phrases_in(F.col("content"), lexical.SERVICE_PHRASES)
    in_header = F.size(F.filter("terms", lambda t: F.lower("metric").contains(t)))
    boost = lexical.service_boost(in_header, F.col("modality") == "table", asked, held, hits)
    return rows.select("qid", "ref", F.round(boost, 6).alias("boost"))


@query("lx06_bm25_rank", f"WITH {LEX_SQL} SELECT qid, doc_id, bm25_score, CAST(bm25_rank AS BIGINT) AS bm25_rank FROM b")
def lx06(spark, sf_dir):
    return lexical_branch(spark, sf_dir).withColumn("bm25_rank", F.col("bm25_rank").cast("long"))


#: Questions cut to their longest token, which few documents have, so that boosts bring most of the rows in.
_LONGEST = f"(SELECT item_id, text, arg_min(t, (-length(t), t)) AS t FROM (SELECT item_id, text, unnest({TOK.format('text')}) AS t FROM benchmark) GROUP BY ALL)"
_RARE_SQL = bm25_sql(f"SELECT item_id AS qid, t AS term FROM {_LONGEST}") + ", " + BOOST_SQL.replace(f"{TOK.format('text')} AS terms, lower(text) AS low FROM benchmark", f"[t] AS terms, lower(text) || ' revenue' AS low FROM {_LONGEST}")


@query("lx06_boosted_rows", f"WITH {_RARE_SQL} SELECT qid, doc_id, round(score + boost, 6) AS bm25_score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score + boost, 6) DESC, doc_id) AS INT) AS bm25_rank FROM bb WHERE round(score + boost, 6) > 0 QUALIFY bm25_rank <= 60")
def lx06_rows(spark, sf_dir):
    """Rows that a boost alone brings in: questions have one rare term, tables and shared phrases do the rest."""
    longest = F.array_sort(X.search_tokens(F.col("text")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", F.lit(" revenue")).alias("text"), F.slice(longest, 1, 1).alias("terms")).where(F.size("terms") > 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("header"), (F.col("lang") == "de").alias("is_table"))
    boosts = lexical.Boosts(docs, asked)
    return lexical.rank_boosted(boosts.of(lexical.bm25(docs, asked, also=boosts.alone(60), first=(60, lexical.MOST))), 60).select("qid", "doc_id", "bm25_score", "bm25_rank")


@query("lx08_discovery", f"WITH {LEX_SQL}, c AS (SELECT qid, source, count(*) AS n FROM b JOIN documents USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, source) AS r, lead(n) OVER (PARTITION BY qid ORDER BY n DESC, source) AS rival FROM c) SELECT qid, source, CAST(n AS BIGINT) AS n FROM r WHERE r = 1 AND n >= 2 AND (rival IS NULL OR n >= 2 * rival)")
def lx08(spark, sf_dir):
    counts = lexical_branch(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("qid", "source").agg(F.count("*").alias("n"))
    return lexical.dominant(counts, "source")


@query("fu01_rrf", f"WITH {RRF_SQL} SELECT qid, doc_id, rrf, CAST(rank AS BIGINT) AS rank FROM h")
def fu01(spark, sf_dir):
    return hybrid(spark, sf_dir).select("qid", "doc_id", "rrf", F.col("rank").cast("long").alias("rank"))


def _sourced(spark, sf_dir) -> DataFrame:
    return hybrid(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")


_SOURCED = f"WITH {RRF_SQL}, s AS (SELECT h.*, source, lang, text FROM h JOIN documents USING (doc_id))"


@query("fu02_parent_collapse", f"{_SOURCED} SELECT qid, source, arg_min(doc_id, rank) AS doc_id, max(rrf) AS rrf, array_to_string(list_filter([CASE WHEN bool_or(bm25_rank IS NOT NULL) THEN 'lexical' END, CASE WHEN bool_or(vector_rank IS NOT NULL) THEN 'vector' END], lambda x: x IS NOT NULL), ',') AS task_ids FROM s GROUP BY qid, source")
def fu02(spark, sf_dir):
    """The best document of each source, with the source's best score and all searches that found one of its documents."""
    found = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("bm25_rank").isNotNull(), "lexical")))
    best = fusion.collapse_best(_sourced(spark, sf_dir).withColumn("task_ids", found), "source", "rrf", "task_ids")
    return best.select("qid", "source", "doc_id", "rrf", F.array_join("task_ids", ",").alias("task_ids"))


@query("fu03_parent_expand", f"{_SOURCED}, p AS (SELECT source, min(doc_id) AS parent_id FROM documents GROUP BY source) SELECT qid, s.doc_id, p.parent_id, md5(CASE WHEN contains(d.text, s.text) THEN d.text ELSE s.text || chr(10) || chr(10) || d.text END) AS context_md5 FROM s JOIN p USING (source) JOIN documents d ON d.doc_id = p.parent_id WHERE rank <= 8")
def fu03(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parents = docs.groupBy("source").agg(F.min("doc_id").alias("parent_id")).join(docs.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent")), "parent_id")
    both = _sourced(spark, sf_dir).where("rank <= 8").join(parents, "source")
    context = F.when(F.col("parent").contains(F.col("text")), F.col("parent")).otherwise(F.concat("text", F.lit("\n\n"), "parent"))
    return both.select("qid", "doc_id", "parent_id", F.md5(context).alias("context_md5"))


@query("fu04_rerank", f"WITH {RRF_SQL} SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY m DESC NULLS LAST, rank, doc_id) AS BIGINT) AS rank FROM (SELECT qid, doc_id, rank, CASE WHEN rank <= 24 THEN round(coalesce(bm25_score, 0), 6) END AS m FROM h)")
def fu04(spark, sf_dir):
    h = hybrid(spark, sf_dir)
    model = h.where("rank <= 24").select("qid", "doc_id", F.round(F.coalesce("bm25_score", F.lit(0.0)), 6).alias("rerank_score"))
    return fusion.rerank(h, model).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("fu05_rerank_text", "SELECT doc_id, md5(left('source=' || source || ' lang=' || lang || chr(10) || text, 2000)) AS text_md5 FROM documents")
def fu05(spark, sf_dir):
    t = F.concat(F.lit("source="), "source", F.lit(" lang="), "lang", F.lit("\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring(t, 1, 2000)).alias("text_md5"))


@query("fu08_promotion", f"WITH {RRF_SQL}, e AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))), p AS (SELECT coalesce(h.qid, e.qid) AS qid, coalesce(h.doc_id, e.doc_id) AS doc_id, rank, e.qid IS NOT NULL AS promoted FROM h FULL JOIN e ON h.qid = e.qid AND h.doc_id = e.doc_id) SELECT qid, doc_id, promoted, CAST(row_number() OVER (PARTITION BY qid ORDER BY promoted DESC, rank NULLS LAST, doc_id) AS BIGINT) AS final_rank FROM p")
def fu08(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.lower("text").alias("phrase"))
    exact = relational.contains_join(docs, items, "doc_id", "low", "qid", "phrase")
    return fusion.promote(hybrid(spark, sf_dir), exact).select("qid", "doc_id", "promoted", F.col("final_rank").cast("long").alias("final_rank"))


@query("fu09_multi_query", f"WITH {RRF_SQL}, u AS (SELECT qid, doc_id, 'vector' AS task_id, score FROM v UNION ALL SELECT qid, doc_id, 'lexical', bm25_score FROM b) SELECT qid, doc_id, max(score) AS score, array_to_string(list_sort(list_distinct(list(task_id))), ',') AS task_ids FROM u GROUP BY ALL")
def fu09(spark, sf_dir):
    hits = vector_branch(spark, sf_dir).select("qid", "doc_id", F.lit("vector").alias("task_id"), "score").unionByName(lexical_branch(spark, sf_dir).select("qid", "doc_id", F.lit("lexical").alias("task_id"), F.col("bm25_score").alias("score")))
    return fusion.multi_query(hits).withColumn("task_ids", F.array_join("task_ids", ","))


@query("fu10_scope_anchors", f"{_SOURCED}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, lang ORDER BY rank) AS n FROM s) SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, rank) AS BIGINT) AS final_rank FROM t")
def fu10(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("qid", "lang").orderBy("rank"))
    t = _sourced(spark, sf_dir).withColumn("n", n)
    return t.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy(F.when(F.col("n") == 1, 0).otherwise(1), "rank")).cast("long").alias("final_rank"))


@query(
    "fu11_near_duplicates",
    f"WITH t AS (SELECT doc_id, source, {TOK.format('text')} AS t FROM documents), e AS (SELECT doc_id, source, unnest(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')))) AS x FROM t WHERE len(t) >= 20), n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id), "
    "s AS (SELECT doc_id, source, md5(string_agg(x, '|' ORDER BY x)) AS h FROM e GROUP BY ALL), r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h, source) AS f FROM s), "
    "i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.source = b.source AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT f FROM r) AND b.doc_id IN (SELECT f FROM r) GROUP BY ALL) "
    "SELECT a, b, round(i / (na.n + nb.n - i), 6) AS jaccard FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE i * 100 >= 82 * (na.n + nb.n - i) UNION ALL SELECT f, doc_id, 1.0 FROM r WHERE f <> doc_id",
)
def fu11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", X.search_tokens(F.col("text")).alias("tokens"))
    return fusion.near_duplicates(docs)


_GREEDY = (
    f"WITH RECURSIVE t AS (SELECT doc_id, source, {TOK.format('text')} AS t FROM documents), e AS (SELECT doc_id, source, unnest(list_distinct(list_transform(range(1, len(t) - 3), lambda i: hash(array_to_string(t[i:i+4], ' '))))) AS x FROM t WHERE len(t) >= 20), n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id), "
    "i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.source = b.source AND a.doc_id < b.doc_id GROUP BY ALL), p AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE i * 100 >= 82 * (na.n + nb.n - i)), "
    "o AS (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS k FROM p GROUP BY b), "
    # the pass itself, one dropped row after the other: what is in no list of them was kept
    "g(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN len(list_filter(before, lambda a: NOT list_contains(gone, a))) > 0 THEN list_append(gone, b) ELSE gone END FROM g JOIN o ON o.k = g.k + 1), "
    "z AS (SELECT arg_max(gone, k) AS gone FROM g), "
)


@query("fu11_greedy_kept", _GREEDY + "l AS (SELECT b, min(a) AS leader FROM p, z WHERE list_contains(gone, b) AND NOT list_contains(gone, a) GROUP BY b) SELECT doc_id, leader IS NULL AS kept, coalesce(leader, doc_id) AS leader FROM documents LEFT JOIN l ON b = doc_id")
def fu11_greedy(spark, sf_dir):
    """The pass over all documents in order: near-duplicates of what was kept go, and name the row that stays for them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", X.search_tokens(F.col("text")).alias("tokens"))
    return fusion.near_kept(docs)


@query("fu12_balanced_topk", f"{_SOURCED}, t AS (SELECT *, CASE WHEN lang IN ('en', 'de') THEN lang END AS task_id FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY qid, task_id ORDER BY rank, doc_id) AS n FROM t), k AS (SELECT *, CASE WHEN task_id IS NULL THEN 2 WHEN n = 1 THEN 0 ELSE 1 END AS tier FROM r) SELECT qid, doc_id, CAST(tier AS INT) AS tier, CAST(final_rank AS BIGINT) AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, rank, doc_id) AS final_rank FROM k) WHERE final_rank <= 8")
def fu12(spark, sf_dir):
    t = _sourced(spark, sf_dir).withColumn("task_id", F.when(F.col("lang").isin("en", "de"), F.col("lang")))
    return fusion.balanced(t, 8).select("qid", "doc_id", "tier", F.col("final_rank").cast("long").alias("final_rank"))


@query("fu13_atomic_scopes", "SELECT item_id, c AS company, y AS year FROM benchmark CROSS JOIN (SELECT DISTINCT n_name AS c FROM nation) CROSS JOIN (SELECT unnest([2022, 2023, 2024]) AS y) WHERE item_id % 25 = (SELECT min(n_nationkey) FROM nation WHERE n_name = c)")
def fu13(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").groupBy("n_name").agg(F.min("n_nationkey").alias("k"))
    tasks = table(spark, sf_dir, "benchmark").join(nations, F.col("item_id") % 25 == F.col("k")).select("item_id", F.array("n_name").alias("companies"), F.array(*[F.lit(y) for y in (2022, 2023, 2024)]).alias("years"))
    return tasks.select("item_id", F.explode_outer("companies").alias("company"), "years").select("item_id", "company", F.explode_outer("years").alias("year"))


@query("fu14_budget", "SELECT conv_id, CAST(CASE WHEN n <= 1 THEN 3 ELSE least(24, 2 * n) END AS BIGINT) AS final_k, CAST(CASE WHEN n <= 1 THEN 12 ELSE greatest(16, 2 * least(24, 2 * n)) END AS BIGINT) AS candidates FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n FROM conversations GROUP BY conv_id)")
def fu14(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n"))
    final, candidates = fusion.budget(F.col("n"), 24)
    return n.select("conv_id", final.cast("long").alias("final_k"), candidates.cast("long").alias("candidates"))


@query("fu19_packing", f"{_SOURCED}, w AS (SELECT qid, doc_id, rank, least(length(text), 1800) AS want FROM s WHERE rank <= 20), g AS (SELECT *, greatest(0, least(want, 8000 - coalesce(sum(want) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS given FROM w) SELECT qid, doc_id, CAST(given AS BIGINT) AS given FROM g WHERE given > 0")
def fu19(spark, sf_dir):
    return fusion.pack(_sourced(spark, sf_dir).where("rank <= 20"), 8000, 1800).select("qid", "doc_id", "given")


_BATCH = f"SELECT item_id * 1000 + i AS qid, unnest({TOK.format('part')}) AS term FROM (SELECT item_id, generate_subscripts(string_split(replace(text, '. ', '|'), '|'), 1) AS i, unnest(string_split(replace(text, '. ', '|'), '|')) AS part FROM benchmark)"


@query("fu21_batch_search", f"WITH {bm25_sql(_BATCH)}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM bs) SELECT qid // 1000 AS item_id, string_agg('[' || CAST(qid % 1000 AS VARCHAR) || '] ' || CAST(doc_id AS VARCHAR), ' ' ORDER BY qid, r) AS found FROM r WHERE r <= 3 GROUP BY qid // 1000")
def fu21(spark, sf_dir):
    """A text of several queries, parted by a bar: each is searched, and what they find is put together in order."""
    batch = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit(". "), F.lit("|")).alias("batch"))
    asked = batch.select("item_id", F.posexplode(F.split("batch", r"\|")).alias("i", "part")).select((F.col("item_id") * 1000 + F.col("i") + 1).alias("qid"), X.search_tokens(F.col("part")).alias("terms"))
    best = relational.top_per(lexical.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), asked), ["qid"], [F.desc("score"), F.col("doc_id")], 3)
    line = F.concat(F.lit("["), (F.col("qid") % 1000).cast("string"), F.lit("] "), F.col("doc_id").cast("string"))
    each = best.select(F.floor(F.col("qid") / 1000).cast("long").alias("item_id"), F.struct("qid", "rank", line.alias("line")).alias("s"))
    return each.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), " ").alias("found"))


@query("au07_retrieval_gate", rf"""{_SOURCED}, e AS (SELECT qid, string_agg(text, chr(10)) AS ev, max(bm25_score) AS best FROM s WHERE rank <= 8 GROUP BY qid), qq AS (SELECT item_id AS qid, text, list_distinct({TOK.format('text')}) AS qt FROM benchmark), j AS (SELECT qq.qid, ev, best, qq.text, qt, len(list_intersect(qt, {TOK.format("coalesce(ev, '')")})) AS matched, regexp_matches(qq.text, '(?i)(how many|how much|accuracy|f1|bleu|rouge|percent|percentage|number|count|score)') AS numq, regexp_matches(coalesce(ev, ''), '\d') AS nume FROM qq LEFT JOIN e USING (qid)) SELECT qid, CASE WHEN len(qt) = 0 THEN 1e0 ELSE round(CAST(matched AS DOUBLE) / len(qt), 6) END AS coverage, CASE WHEN ev IS NULL OR (numq AND NOT nume) OR (len(qt) > 0 AND matched = 0) THEN 'REJECT' WHEN (len(qt) > 0 AND CAST(matched AS DOUBLE) / len(qt) < 0.5) OR coalesce(best < 40, false) THEN 'CAUTION' ELSE 'PASS' END AS status FROM j""")
def au07(spark, sf_dir):
    from ..operators.audit import retrieval_gate

    evidence = _sourced(spark, sf_dir).where("rank <= 8").select("qid", "text", F.col("bm25_score").alias("rerank_score"))
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return retrieval_gate(questions, evidence, floor=40.0)


@query("ev09_ranking_metrics", f"""WITH r AS (SELECT qid, rank, CASE WHEN g.label = c.label THEN 1 ELSE 0 END AS rel, g.label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) n JOIN embeddings g ON g.vec_id = qid JOIN embeddings c ON c.vec_id = n.vec_id WHERE rank <= 10),
gold AS (SELECT a.vec_id AS qid, count(b.vec_id) AS gold FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL), ks AS (SELECT unnest([1, 3, 5, 10]) AS k), p AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM r)
SELECT qid, CAST(k AS INT) AS k, round(CASE WHEN gold > 0 THEN sum(rel) / CAST(gold AS DOUBLE) END, 6) AS recall, round(CASE WHEN gold > 0 THEN coalesce(max(CASE WHEN rel = 1 THEN 1e0 / rank END), 0) END, 6) AS mrr, round(CASE WHEN gold > 0 THEN sum(CASE WHEN rel = 1 THEN hits / CAST(rank AS DOUBLE) ELSE 0 END) / least(gold, k) END, 6) AS map, round(CASE WHEN gold > 0 THEN sum(rel / log2(rank + 1)) / list_sum(list_transform(range(1, least(gold, k) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg, CASE WHEN gold > 0 THEN CAST(sum(rel) >= gold AS DOUBLE) END AS complete_recall FROM p JOIN gold USING (qid) JOIN ks ON rank <= k GROUP BY qid, k, gold""")
def ev09(spark, sf_dir):
    from ..operators.evaluate import ranking_metrics

    vec = _vectors(spark, sf_dir)
    near = vector.knn(vec, _hundredth(spark, sf_dir), 10)
    labels = vec.select("vec_id", "label")
    asked = labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("gold_label"))
    ranked = near.join(labels, "vec_id").join(relational.small(asked), "qid").select("qid", "rank", (F.col("label") == F.col("gold_label")).cast("int").alias("rel"))
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("gold"))
    gold = asked.join(sizes, F.col("label") == F.col("gold_label")).select("qid", "gold")
    return ranking_metrics(ranked, gold)
