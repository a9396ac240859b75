"""Source and corpus queries: scans, listings, upserts, samples, metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import covers, lexical, relational
from .base import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("sc07_metadata_scan", "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS pos FROM documents WHERE lang = 'en' QUALIFY pos <= 2000")
def sc07(spark, sf_dir):
    return relational.top_per(_docs(spark, sf_dir).where("lang = 'en'").select("source", "doc_id"), ["source"], [F.col("doc_id")], 2000, "pos").withColumn("pos", F.col("pos").cast("long"))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_INDEX = f"d AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS t FROM documents) GROUP BY ALL)"


@query("sc08_term_scan", f"WITH q AS (SELECT item_id, {_WORDS} AS w FROM benchmark), k AS (SELECT item_id, unnest(list_filter(w, lambda v, i: NOT list_contains(w[1:i-1], v))[1:16]) AS t FROM q), {_INDEX}, h AS (SELECT item_id, doc_id, count(*) AS hits, CAST(sum(tf) AS BIGINT) AS times FROM k JOIN d USING (t) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, times DESC, doc_id) AS BIGINT) AS rank FROM h")
def sc08(spark, sf_dir):
    """Documents that hold any of a question's 16 first distinct terms, ranked by how many they hold, then how often."""
    return lexical.term_scan(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), most=16).withColumn("rank", F.col("rank").cast("long"))


@query("sc10_all_terms_scan", f"WITH q AS (SELECT item_id, list_distinct({_WORDS}) AS ts FROM benchmark), k AS (SELECT item_id, len(ts) AS n, unnest(ts) AS t FROM q), {_INDEX}, h AS (SELECT item_id, doc_id, count(*) AS hits, CAST(sum(tf) AS BIGINT) AS times FROM k JOIN d USING (t) GROUP BY item_id, doc_id, n HAVING count(*) = n) SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, times DESC, doc_id) AS BIGINT) AS rank FROM h")
def sc10(spark, sf_dir):
    """Documents that hold all terms of a question, ranked by how often they do."""
    held = covers.holding(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("item_id", "doc_id", F.col("n").cast("long").alias("hits"), F.size("spots").cast("long").alias("times"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), F.desc("times"), "doc_id"))
    return held.withColumn("rank", rank.cast("long"))


#: Distinct terms of an item in order, numbered; {0}: how many at most.
_ASKED = f"q AS (SELECT item_id, list_filter(w, lambda v, i: NOT list_contains(w[1:i-1], v))[1:{{0}}] AS ts FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)), k AS (SELECT item_id, len(ts) AS n, unnest(ts) AS t FROM q)"
_SPOTS = f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents), o AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS t FROM w)"
#: Covers by their first position: of each term its next place from there on, as long as the first term isn't met again.
_COVERS = f"{_SPOTS}, m AS (SELECT item_id, n, doc_id, p, t FROM k JOIN o USING (t)), a AS (SELECT item_id, doc_id FROM m GROUP BY item_id, doc_id, n HAVING count(DISTINCT t) = n), s AS (SELECT m.*, row_number() OVER d AS x, lag(p) OVER e AS before, lead(p) OVER e AS after FROM m JOIN a USING (item_id, doc_id) WINDOW d AS (PARTITION BY item_id, doc_id ORDER BY p), e AS (PARTITION BY item_id, doc_id, t ORDER BY p)), c AS (SELECT a.item_id, a.doc_id, a.p, a.x, max(b.p) AS e, max(b.x) AS y FROM s a JOIN s b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.p >= a.p AND (a.after IS NULL OR b.p < a.after) AND (b.before IS NULL OR b.before < a.p) GROUP BY a.item_id, a.doc_id, a.p, a.x, a.n HAVING count(*) = a.n), r AS (SELECT item_id, doc_id, round(sum(0.1e0 / (1 + (e - p) - (y - x))), 6) AS score, CAST(count(*) AS INT) AS covers FROM c GROUP BY ALL)"
_TOP = "CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank"


@query("sc08_cover_density", f"WITH {_ASKED.format(16)}, {_INDEX}, h AS (SELECT item_id, doc_id, round(0.1e0 * sum(tf), 6) AS score FROM k JOIN d USING (t) GROUP BY ALL) SELECT *, {_TOP} FROM h QUALIFY rank <= 100")
def sc08_covers(spark, sf_dir):
    """Documents that hold any of a question's 16 first distinct terms, ranked by cover density, from a written index."""
    asked = covers.asked_terms(table(spark, sf_dir, "benchmark"), most=16)
    index = covers.written_index(_docs(spark, sf_dir))
    wanted = index.join(relational.small(asked.select("t", covers.part_of(F.col("t")).alias("part")).distinct()), ["part", "t"], "left_semi")
    return covers.ranked(covers.any_term(wanted, asked), 100)


@query("sc10_cover_density", f"WITH {_ASKED.format(3)}, {_COVERS} SELECT *, {_TOP} FROM r QUALIFY rank <= 100")
def sc10_covers(spark, sf_dir):
    """Documents that hold the first three distinct terms of a question, ranked by the density of their covers."""
    asked = covers.asked_terms(table(spark, sf_dir, "benchmark"), most=3)
    return covers.ranked(covers.all_terms(covers.positions(_docs(spark, sf_dir), asked), asked), 100)


@query("sc10_whole_questions", f"WITH {_ASKED.format(100000)}, {_COVERS} SELECT *, {_TOP} FROM r QUALIFY rank <= 100")
def sc10_whole(spark, sf_dir):
    """The same for all terms of a question."""
    return covers.ranked(covers.swept(covers.holding(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))), 100)


@query("sc09_phrase_scan", "SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY length(d.text), doc_id) AS BIGINT) AS pos FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) QUALIFY pos <= 24")
def sc09(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.lower("text").alias("low"), F.length("text").alias("chars"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("phrase"))
    hits = relational.contains_join(docs, items, "doc_id", "low", "item_id", "phrase").join(docs.select("doc_id", "chars"), "doc_id")
    return relational.top_per(hits, ["item_id"], [F.col("chars"), F.col("doc_id")], 24, "pos").select("item_id", "doc_id", F.col("pos").cast("long").alias("pos"))


@query("sc12_insert_new", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def sc12(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.insert_new(old, table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("sc14_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def sc14(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("sc16_distinct_listing", "SELECT DISTINCT source, lang FROM documents")
def sc16(spark, sf_dir):
    return _docs(spark, sf_dir).select("source", "lang").distinct()


@query("sc17_status", "SELECT source, count(*) AS chunks, CAST(count(DISTINCT lang) AS BIGINT) AS langs, count(*) FILTER (WHERE n_chars > 2000) AS long, count(*) FILTER (WHERE lang = 'en') AS english FROM documents GROUP BY source")
def sc17(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("lang").alias("langs"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.count_if(F.col("lang") == "en").alias("english"))


#: Documents in one digest of a manifest: a range of ids, whatever the source's size.
_RANGE = 1000


@query("sc18_manifest", f"WITH r AS (SELECT source, doc_id // {_RANGE} AS part, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, md5(string_agg(sha256(text), ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY ALL) SELECT source, part, bytes, digest FROM r")
def sc18(spark, sf_dir):
    """A manifest: bytes and a digest of each source's documents, a row for each range of a thousand ids."""
    return relational.manifest(_docs(spark, sf_dir), "source", "doc_id", "text", _RANGE)


@query("sc18_verify", "SELECT source, CASE WHEN doc_id % 103 = 0 THEN 'missing' WHEN doc_id % 97 = 0 THEN 'size' WHEN doc_id % 101 = 0 THEN 'digest' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT source, 'unlisted', count(*) FROM documents WHERE doc_id % 89 = 0 GROUP BY source")
def sc18_verify(spark, sf_dir):
    """Documents held against a manifest that states other sizes and digests for some, lacks some and has some too many."""
    docs = _docs(spark, sf_dir).select("source", "doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha"))
    listed = docs.select("source", "doc_id", (F.col("bytes") + F.when(F.col("doc_id") % 97 == 0, 1).otherwise(0)).alias("bytes"), F.when(F.col("doc_id") % 101 == 0, "other").otherwise(F.col("sha")).alias("sha"))
    more = docs.where("doc_id % 89 = 0").select("source", (-1 - F.col("doc_id")).alias("doc_id"), "bytes", "sha")
    return relational.verified(listed, docs.where("doc_id % 103 <> 0").unionByName(more), ["source", "doc_id"]).groupBy("source", "status").agg(F.count("*").alias("n"))


@query("sc20_sampling", "WITH h AS (SELECT doc_id, source, lang, md5('7:' || doc_id) AS h FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY h, doc_id) AS r FROM h) SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, h, doc_id) AS k FROM c) WHERE k <= 120")
def sc20(spark, sf_dir):
    """A sampling operator: a seeded order that first covers each source and language, then fills up to n."""
    h = _docs(spark, sf_dir).select("doc_id", "source", "lang", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("h"))
    first = h.groupBy("source", "lang").agg(F.min(F.struct("h", "doc_id")).alias("m")).select("source", "lang", "m.h", "m.doc_id", F.lit(0).alias("tier"))
    # the rest can only fill up: its first rows by hash are enough, with as many more as may be covered already
    rest = h.orderBy("h", "doc_id").limit(240).join(first.select("doc_id"), "doc_id", "left_anti").withColumn("tier", F.lit(1))
    return first.unionByName(rest).orderBy("tier", "h", "doc_id").limit(120).select("doc_id", "source", "lang")


@query("sc21_round_robin", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY r, source) AS k FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)) WHERE k <= 50")
def sc21(spark, sf_dir):
    return relational.round_robin(_docs(spark, sf_dir).select("doc_id", "source"), "source", [F.col("doc_id")], 50)


@query("sc22_ids_in_order", "SELECT item_id, turn AS doc_id_wanted, source IS NOT NULL AS found FROM (SELECT item_id, item_id * 7 AS turn FROM benchmark) LEFT JOIN documents ON doc_id = turn")
def sc22(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 7).alias("doc_id_wanted"))
    out = relational.in_order(_docs(spark, sf_dir).select("doc_id"), "doc_id", wanted.withColumnRenamed("doc_id_wanted", "id").select("item_id", "id"))
    return out.select("item_id", F.col("id").alias("doc_id_wanted"), "found")


@query("fl01_filters", "SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en'")
def fl01(spark, sf_dir):
    from ..operators.filters import equals

    return _docs(spark, sf_dir).where(equals(source="src3", lang="en", missing="")).select("doc_id", "source", "lang")


@query("fl02_any_of", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_type = 'Brand#11' OR p_name LIKE '%11%'")
def fl02(spark, sf_dir):
    return table(spark, sf_dir, "part").where((F.col("p_brand") == "Brand#11") | (F.col("p_type") == "Brand#11") | F.col("p_name").like("%11%")).select("p_partkey")


@query("fl04_relaxation", "WITH t AS (SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS tier FROM customer) SELECT c_nationkey, c_custkey, CAST(tier AS INT) AS tier FROM (SELECT *, min(tier) OVER (PARTITION BY c_nationkey) AS least FROM t) WHERE tier = least")
def fl04(spark, sf_dir):
    from ..operators.filters import relaxed

    tiers = [(F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000), F.col("c_mktsegment") == "BUILDING", F.lit(True)]
    return relaxed(table(spark, sf_dir, "customer"), "c_nationkey", tiers).select("c_nationkey", "c_custkey", "tier")


@query("fl08_modality", "SELECT doc_id, source FROM (SELECT *, max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS has FROM documents) WHERE has = 0 OR lang = 'de'")
def fl08(spark, sf_dir):
    from ..operators.filters import prefer

    return prefer(_docs(spark, sf_dir), "source", F.col("lang") == "de").select("doc_id", "source")


@query("fl12_title_like", "SELECT page_id FROM pages WHERE contains(lower(url), 'example.com')")
def fl12(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.lower("url").contains("example.com")).select("page_id")


@query("ch02_normalize", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def ch02(spark, sf_dir):
    from ..functions.text import clean_line

    return table(spark, sf_dir, "pages").select("page_id", F.md5(clean_line(F.regexp_replace("html", "<[^>]*>", " "))).alias("text_md5"))


@query("ch15_chunk_cap", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) AS n FROM documents) WHERE n <= 20")
def ch15(spark, sf_dir):
    return relational.top_per(_docs(spark, sf_dir), ["source"], [F.when(F.col("lang") == "en", 0).otherwise(1), F.col("doc_id")], 20, "n").select("source", "doc_id")


@query("ch21_metadata", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs, CAST(arg_min(doc_id, doc_id) AS BIGINT) AS first_doc, bool_or(n_chars > 5000) AS has_long FROM documents GROUP BY source")
def ch21(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.min("doc_id").alias("first_doc"), F.bool_or(F.col("n_chars") > 5000).alias("has_long"))


@query("ch22_required", "SELECT c_custkey, c_mktsegment, CAST(y AS INT) AS year FROM customer CROSS JOIN (SELECT unnest([1996, 1997, 1998]) AS y) WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y)")
def ch22(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.explode(F.array(*[F.lit(y) for y in (1996, 1997, 1998)])).alias("year"))
    manifest = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).distinct()
    return wanted.join(manifest, ["c_custkey", "year"], "left_semi").select("c_custkey", "c_mktsegment", "year")
