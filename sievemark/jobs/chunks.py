"""Chunking queries over whole pages and documents, and over filings made from order lines.

A filing is the page of an order: a preface, headings, prose with dates, a table of its evidence and more prose, most of
which hang on the order. What its parts hold is known, so SQL can say what extraction must give; windows over whole texts
are held against brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, markup
from .base import query, table
from .cases import EV_SQL, evidence

#: What a filing's parts hang on, in expressions that Spark and DuckDB read alike.
_FACTS = {
    "y": "CAST(2021 + qid % 4 AS STRING)",
    "p": "CAST(2020 + qid % 4 AS STRING)",
    "day": "concat(CASE qid % 3 WHEN 0 THEN 'June' WHEN 1 THEN 'March' ELSE 'December' END, ' ', CAST(1 + qid % 28 AS STRING), ', ')",
    "item": "CASE qid % 4 WHEN 0 THEN 'Item 7' WHEN 1 THEN 'Item 1A' WHEN 2 THEN 'Item 3' ELSE '' END",
    "title": "CASE qid % 4 WHEN 0 THEN 'Results of Operations' WHEN 1 THEN 'Risk Factors' WHEN 2 THEN 'Legal Proceedings' ELSE '' END",
}
_PROSE = {
    "preface": "concat('Preface of ', CAST(qid AS STRING), '.')",
    "before": "concat('As of ', day, y, ', order ', CAST(qid AS STRING), ' had words.')",
    "after": "concat('After fy', y, ' come words', CASE WHEN qid % 5 = 0 THEN concat('; year ended ', day, p) ELSE '' END, '.')",
}
_SECOND = "<tr><td>Fiscal year ended</td><td>(in millions)</td><td></td></tr><tr><td></td><td> </td><td></td></tr>"
_cols = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())
_F = f"{EV_SQL}, f0 AS (SELECT qid, {_cols(_FACTS)} FROM (SELECT DISTINCT qid FROM ev)), f AS (SELECT *, {_cols(_PROSE)} FROM f0)"


def filings(spark, sf_dir) -> DataFrame:
    """(qid, html): a page for each order."""
    row = F.concat(F.lit("<tr><td>"), "metric", F.lit("</td><td>"), F.col("amount").cast("string"), F.lit("</td><td>a|b &amp; <b>"), F.col("prior").cast("string"), F.lit("</b></td></tr>"))
    rows = evidence(spark, sf_dir).select("qid", F.struct("pos", row.alias("row")).alias("s")).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["row"]), "").alias("rows"))
    made = rows.selectExpr("*", *[f"{e} AS {n}" for n, e in _FACTS.items()]).selectExpr("*", *[f"{e} AS {n}" for n, e in _PROSE.items()])
    heading = F.when(F.col("item") != "", F.concat(F.lit("<p>"), "item", F.lit(". "), "title", F.lit("</p>"))).otherwise("")
    head = F.concat(F.lit("<table class='x'><tr><th>Metric</th><th>FY"), "y", F.lit("</th><th> Fiscal  "), "p", F.lit(" </th></tr>"), F.when(F.col("qid") % 3 == 0, _SECOND).otherwise(""))
    html = F.concat(F.lit("<html><head><style>p{}</style></head><body><p>"), "preface", F.lit("</p>"), heading, F.lit("<p>"), "before", F.lit("</p>"), head, "rows", F.lit("</table><p>"), "after", F.lit("</p><p>Item 8 - Statements</p><p>The end.</p></body></html>"))
    return made.select("qid", html.alias("html"))


def _tables(spark, sf_dir) -> DataFrame:
    """(qid, rows): each filing's first table."""
    return filings(spark, sf_dir).select("qid", chunking.matrices(markup.page_tables("html"))[0].alias("rows"))


def _texts(spark, sf_dir) -> DataFrame:
    return filings(spark, sf_dir).select("qid", chunking.many_lines(markup.page_text("html")).alias("text"))


def _around(spark, sf_dir) -> DataFrame:
    """(qid, html, texts): what lies before and after the table."""
    place = lambda mark, more: (F.instr("html", mark) - 1 + more).cast("int")
    return filings(spark, sf_dir).select("qid", "html", chunking.around(F.col("html"), place("<table", 0), place("</table>", 8)).alias("texts"))


#: The rows of a filing's table, header rows at 0 and -1.
_ROWS = "rr AS (SELECT qid, pos AS n, [metric, CAST(amount AS VARCHAR), 'a|b & ' || CAST(prior AS VARCHAR)] AS c FROM ev UNION ALL SELECT qid, -1, ['Metric', 'FY' || y, 'Fiscal ' || p] FROM f UNION ALL SELECT qid, 0, ['Fiscal year ended', '(in millions)', ''] FROM f WHERE qid % 3 = 0)"
_LINE = "'| ' || array_to_string(list_transform(c, lambda x: replace(x, '|', '/')), ' | ') || ' |'"
_MARKDOWN = f"md AS (SELECT qid, string_agg({_LINE} || CASE WHEN n = -1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY n) AS markdown FROM rr GROUP BY qid)"
#: The first row is a header; of the next three, those that have few numbers or a header's word, as long as all before do.
_HEADS = rf"k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n) AS r, list_filter(c, lambda x: trim(x) <> '') AS f FROM rr), h AS (SELECT *, r = 1 OR (len(f) > 0 AND len(list_filter(f, lambda x: regexp_matches(x, '[0-9]'))) <= greatest(1, len(f) // 3)) OR regexp_matches(array_to_string(c, ' '), '(?i){chunking.HEADER_WORDS}') AS heads FROM k WHERE r <= 4), g AS (SELECT *, bool_and(heads) OVER (PARTITION BY qid ORDER BY r) AS top FROM h)"


@query("ch03_table_matrix", f"WITH {_F}, {_ROWS} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY n) - 1 AS INT) AS row, array_to_string(c, '; ') AS cells FROM rr")
def ch03(spark, sf_dir):
    return chunking.exploded(_tables(spark, sf_dir), F.col("rows"), "row", "c").select("qid", "row", F.array_join("c", "; ").alias("cells"))


@query("ch04_markdown", f"WITH {_F}, {_ROWS}, {_MARKDOWN} SELECT qid, markdown FROM md")
def ch04(spark, sf_dir):
    return _tables(spark, sf_dir).select("qid", chunking.markdown(F.col("rows")).alias("markdown"))


@query("ch05_header_rows", f"WITH {_F}, {_ROWS}, {_HEADS} SELECT qid, CAST(count(*) AS INT) AS rows, left(array_to_string(flatten(list(f ORDER BY r)), ' | '), 800) AS header FROM g WHERE top GROUP BY qid")
def ch05(spark, sf_dir):
    return _tables(spark, sf_dir).select("qid", chunking.header_rows(F.col("rows")).alias("rows"), chunking.header_text(F.col("rows")).alias("header"))


_PIECES = f"""hd AS (SELECT qid, count(*) AS m, 'Table header: ' || left(array_to_string(flatten(list(f ORDER BY r)), ' | '), 800) || chr(10) || string_agg({_LINE}, chr(10) ORDER BY r) AS head FROM g WHERE top GROUP BY qid),
b AS (SELECT k.qid, head, {_LINE} AS line, row_number() OVER (PARTITION BY k.qid ORDER BY r) AS i FROM (SELECT *, max(r) OVER (PARTITION BY qid) AS rows FROM k) k JOIN hd USING (qid) WHERE r > m OR r = m AND rows = m),
w AS (SELECT qid, i, 0 AS piece, len(head) + 1 + len(line) AS size, len(line) AS last FROM b WHERE i = 1
UNION ALL SELECT b.qid, b.i, CASE WHEN size + len(line) + 1 > 240 THEN piece + 1 ELSE piece END, CASE WHEN size + len(line) + 1 > 240 THEN len(head) + last + 1 ELSE size END + len(line) + 1, len(line) FROM w JOIN b ON b.qid = w.qid AND b.i = w.i + 1),
l AS (SELECT qid, i, piece FROM w UNION ALL SELECT w.qid, w.i, w.piece + 1 FROM w JOIN w v ON v.qid = w.qid AND v.i = w.i + 1 AND v.piece > w.piece),
o AS (SELECT qid, piece, any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS content FROM l JOIN b USING (qid, i) GROUP BY qid, piece)"""


@query("ch06_table_chunks", f"WITH RECURSIVE {_F}, {_ROWS}, {_HEADS}, {_PIECES} SELECT qid, CAST(piece AS INT) AS piece, content FROM o")
def ch06(spark, sf_dir):
    return chunking.exploded(_tables(spark, sf_dir), chunking.table_chunks(F.col("rows"), 240), "piece", "content").drop("rows")


_TOKENS = lambda x: rf"regexp_extract_all({x}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?|[^\w\s]')"


@query("ch07_table_context", f"WITH {_F} SELECT qid, array_to_string(list_slice(t, -15, -1), ' ') AS before, array_to_string(list_slice(u, 1, 15), ' ') AS after FROM (SELECT qid, {_TOKENS('''concat(preface, ' ', item, CASE WHEN item <> '' THEN '. ' ELSE '' END, title, ' ', before)''')} AS t, {_TOKENS('''after || ' Item 8 - Statements The end.' ''')} AS u FROM f)")
def ch07(spark, sf_dir):
    return _around(spark, sf_dir).select("qid", chunking.table_context(F.col("texts"), 15).alias("c")).select("qid", "c.before", "c.after")


@query(
    "ch08_periods",
    f"WITH {_F} SELECT qid, concat('As of ', day, y, CASE WHEN qid % 5 = 0 THEN concat(', ', day, p, ', year ended ', day, p) ELSE '' END, ', FY', y, ', Fiscal ', p) AS periods, concat(y, ', ', p) AS years, concat('As of ', day, y) AS first FROM f",
)
def ch08(spark, sf_dir):
    found = _texts(spark, sf_dir).select("qid", chunking.periods(chunking.one_line(F.col("text"))).alias("p"))
    return found.select("qid", F.array_join("p.periods", ", ").alias("periods"), F.array_join("p.years", ", ").alias("years"), "p.first")


@query(
    "ch09_sections",
    f"WITH {_F}, s AS (SELECT qid, 0 AS place, '' AS item, '' AS title FROM f UNION ALL SELECT qid, 1, item, title FROM f WHERE item <> '' UNION ALL SELECT qid, 2, 'Item 8', 'Statements' FROM f) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) - 1 AS INT) AS n, item, title FROM s",
)
def ch09(spark, sf_dir):
    return chunking.exploded(_texts(spark, sf_dir), chunking.sections(F.col("text")), "n", "s").select("qid", "n", "s.item", "s.title")


@query("ch10_item_before", f"WITH {_F} SELECT qid, item, title, 'Item 8' AS last FROM f")
def ch10(spark, sf_dir):
    """The heading before the table, and the last of the page."""
    found = _around(spark, sf_dir).select("qid", chunking.last_item(F.element_at("texts", 1)).alias("b"), chunking.last_item(F.element_at("texts", 2)).alias("l"))
    return found.select("qid", "b.item", "b.title", F.coalesce(F.nullif("l.item", F.lit("")), "b.item").alias("last"))


@query(
    "ch14_interleaved",
    f"WITH {_F}, {_ROWS}, {_MARKDOWN} SELECT qid, concat_ws(chr(10) || chr(10), preface, CASE WHEN item <> '' THEN item || '. ' || title END, before, 'Markdown table:' || chr(10) || replace(markdown, '|  |', '| |'), after, 'Item 8 - Statements', 'The end.') AS text FROM f JOIN md USING (qid)",
)
def ch14(spark, sf_dir):
    return filings(spark, sf_dir).select("qid", chunking.interleaved(F.col("html")).alias("text"))


@query("ch01_html_chunks")
def ch01(spark, sf_dir):
    return chunking.html_chunks(table(spark, sf_dir, "pages"))


@query("ch11_text_windows")
def ch11(spark, sf_dir):
    return chunking.text_chunks(table(spark, sf_dir, "documents"))


@query("ch12_paper_windows")
def ch12(spark, sf_dir):
    return chunking.text_chunks(table(spark, sf_dir, "documents"), size=3000, overlap=300, least=1)


#: Between tokens: white space, underscores and letters outside ASCII; RE2 has no difference of classes, and the texts given have Latin letters only.
_BETWEEN = r"[_\s\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]*"
_TOKEN = r"(?:[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?|[^\p{L}\p{N}_\s])"
_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _cut(out: str, source: str, keys: str, text: str, most: int) -> str:
    """CTEs in which texts are cut into pieces of `most` tokens, numbered by n."""
    lead = f"CASE WHEN n = 0 THEN regexp_extract(t, '^{_BETWEEN}') ELSE '' END"
    return (
        f"{out}0 AS (SELECT {keys}, {text} AS t, regexp_extract_all({text}, '{_TOKEN}{_BETWEEN}') AS a FROM {source}), "
        f"{out}1 AS (SELECT *, unnest(range(0, greatest(1, (len(a) + {most - 1}) // {most}))) AS n FROM {out}0), "
        f"{out} AS (SELECT * EXCLUDE (t), {_STRIP(f'''{lead} || array_to_string(list_slice(a, n * {most} + 1, n * {most} + {most}), '')''')} AS piece FROM {out}1)"
    )


@query(
    "ch13_token_split",
    f"WITH {_cut('p', 'documents', 'doc_id', 'text', 256)}, q AS (SELECT doc_id, CAST(n AS INT) AS parent_index, piece AS parent FROM p WHERE piece <> ''), {_cut('c', 'q', 'doc_id, parent_index, parent', 'parent', 64)} "
    "SELECT doc_id, parent_index, CAST(n AS INT) AS child_index, left(sha256(concat_ws(':', doc_id, parent_index, parent)), 24) AS parent_id, piece AS content FROM c WHERE piece <> ''",
)
def ch13(spark, sf_dir):
    """Parents of 256 context tokens, and children of 64 within each, with their numbers."""
    parents = chunking.exploded(table(spark, sf_dir, "documents").select("doc_id", "text"), chunking.token_pieces(F.col("text"), 256), "parent_index", "parent")
    ident = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "parent_index", "parent"), 256)
    children = chunking.exploded(parents.select("doc_id", "parent_index", "parent", F.substring(ident, 1, 24).alias("parent_id")), chunking.token_pieces(F.col("parent"), 64), "child_index", "content")
    return children.drop("parent")


@query("ch17_parent_windows")
def ch17(spark, sf_dir):
    """Each window of a document with its parent of up to 6000 characters."""
    own = chunking.text_windows(table(spark, sf_dir, "documents")).select("doc_id", "windows", chunking.parent_windows(F.col("windows")).alias("parents"))
    return chunking.exploded(own, F.col("windows"), "chunk_index", "content").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), F.md5(F.col("parents")[F.col("chunk_index")]).alias("parent_md5"))


@query("ch18_paper_children")
def ch18(spark, sf_dir):
    """Children with their paper's and section's name, each cut from its section's parent."""
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.paper_chunks(docs.withColumn("key", F.struct("doc_id", "source")), "key")
    content = F.concat(F.lit("Paper: "), "key.source", F.lit("\nSection: "), F.col("section_index").cast("string"), F.lit("\n"), "content")
    return chunks.select("key.doc_id", "section_index", "chunk_index", content.alias("content"), F.md5("parent").alias("parent_md5"))


@query(
    "ch20_trimmed",
    rf"WITH t AS (SELECT doc_id, left(text, 1152) AS x, regexp_extract_all(left(text, 1152), '{_TOKEN}{_BETWEEN}') AS a, regexp_extract(left(text, 1152), '^{_BETWEEN}') AS lead FROM documents) SELECT doc_id, CASE WHEN len(a) <= 384 THEN regexp_replace(x, '\s+$', '') ELSE regexp_replace(lead || array_to_string(list_slice(a, 1, 384), ''), '{_BETWEEN}$', '') END AS trimmed FROM t",
)
def ch20(spark, sf_dir):
    """Each document cut to what an encoder of 384 tokens takes."""
    return table(spark, sf_dir, "documents").select("doc_id", chunking.trim_to_tokens(F.col("text")).alias("trimmed"))
