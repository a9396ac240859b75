"""Text of HTML, tables, sections, periods, windows and tokens as Column functions, and chunks of pages and documents.

A document's parts are arrays in its row, so nothing is shuffled; operators turn them into rows at the end. White space
is Unicode's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markup import pages, with_windows

# Patterns that define headings of items, periods, header words and context tokens.
ITEM_HEADING = r"\bItem\s+(1A|1B|1C|1|2|3|4|5|6|7A|7|8|9A|9B|9C|9|10|11|12|13|14|15|16)(?:\.\s+|[ \t]+[-–—]\s+|[ \t]{2,})([A-Z][A-Za-z0-9 &,.'’:/()%-]{3,120})"
PERIOD_DATE = r"\b(?:As of|At|As at)?\s*(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+20\d{2}\b"
PERIOD_SPAN = r"\b(?:Year|Years|Fiscal year|Fiscal years|Three months|Six months|Nine months|Twelve months)(?:\s+ended)?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+20\d{2}\b"
PERIOD_FY = r"\bFY\s*20\d{2}\b"
PERIOD_FISCAL = r"\bFiscal\s+20\d{2}\b"
HEADER_WORDS = r"\b(Year|Fiscal|Month|Three Months|Nine Months|December|September|202[0-9])\b"
CONTEXT_TOKEN = r"(?:[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?|[^\p{L}\p{N}_\s])"
#: What may lie between context tokens: white space, underscores, letters and digits outside ASCII.
BETWEEN = r"[\p{L}\p{N}_\s&&[^A-Za-z0-9]]*"
TABLE = r"(?is)<table\b.*?</table>"
#: Characters of the page before an offset in which its item and context are looked for.
LOOK_BACK = 80_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exploded(df: DataFrame, array: Column, index: str, name: str) -> DataFrame:
    """df with a row for each element, and none for a null or empty array. As an inner generator would do it, the
    optimizer would compute the array a second time, in a filter on its size."""
    return df.select("*", F.posexplode_outer(array).alias(index, name)).where(F.col(index).isNotNull())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def many_lines(text: Column) -> Column:
    """Lines without outer or repeated white space, at most one of them empty in a row."""
    lines = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), r"(?U)[\s&&[^\n]]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, " ?\n ?", "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


# -- HTML and tables
def page(html: Column) -> Column:
    """(text, tables) of a page; null is empty."""
    return pages(F.array(F.coalesce(html, F.lit(""))))[0]


def matrix(rows: Column) -> Column:
    """A table's rows padded to one width, without blank ones."""
    return _let(rows, lambda t: _let(F.array_max(F.transform(t, F.size)), lambda width: F.transform(F.filter(t, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))))


def matrices(tables: Column) -> Column:
    return F.filter(F.transform(tables, matrix), lambda t: F.size(t) > 0)


def markdown_rows(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("/"))), " | "), F.lit(" |")))


def markdown(rows: Column) -> Column:
    """The table in Markdown, its first row as the head; empty without rows."""
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    text = _let(markdown_rows(rows), lambda m: F.array_join(F.concat(F.slice(m, 1, 1), F.array(rule), F.slice(m, 2, F.greatest(F.size(m), F.lit(1)))), "\n"))
    return F.when(F.size(rows) > 0, text).otherwise("")


def _heads(row: Column) -> Column:
    filled = F.filter(row, lambda c: F.trim(c) != "")
    few = _let(filled, lambda f: (F.size(f) > 0) & (F.size(F.filter(f, lambda c: c.rlike(r"(?U)\d"))) <= F.greatest(F.lit(1), F.floor(F.size(f) / 3))))
    return few | F.array_join(row, " ").rlike(f"(?iU){HEADER_WORDS}")


def header_rows(rows: Column, most: int = 4) -> Column:
    """Rows at the top that are a header: the first one, and what follows while few of a row's filled cells have a digit
    or the row has a header's word."""
    flags = F.transform(F.slice(rows, 1, most), lambda r, i: (i == 0) | _heads(r))
    return _let(flags, lambda f: F.when(F.array_position(f, F.lit(False)) > 0, F.array_position(f, F.lit(False)) - 1).otherwise(F.size(f)).cast("int"))


def header_text(rows: Column, most: int = 800) -> Column:
    cells = F.filter(F.flatten(F.slice(rows, 1, header_rows(rows))), lambda c: F.trim(c) != "")
    return F.substring(one_line(F.array_join(cells, " | ")), 1, most)


def table_chunks(rows: Column, most: int = 1400, least: int = 80, overlap: bool = True) -> Column:
    """Pieces of a table by rows: each has the header's text and rows, then rows while they fit in `most` characters, and
    begins with the last row of the one before. Pieces of fewer than `least` characters are dropped.

    A fold over the rows' lengths finds where pieces begin and end; texts are joined only then.
    """
    def cuts(lens: Column, base: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("begins"), F.array().cast("array<int>").alias("ends"), base.alias("size"))

        def step(s: Column, i: Column) -> Column:
            full = (i > 0) & (s["size"] + lens[i] + 1 > most)
            again = base + (lens[i - 1] + 1 if overlap else 0)
            return F.struct(
                F.when(full, F.concat(s["begins"], F.array(i - int(overlap)))).otherwise(s["begins"]).alias("begins"),
                F.when(full, F.concat(s["ends"], F.array(i))).otherwise(s["ends"]).alias("ends"),
                (F.when(full, again).otherwise(s["size"]) + lens[i] + 1).alias("size"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(lens) - 1), start, step)

    def pieces(p: Column) -> Column:
        def join(c: Column) -> Column:
            ends = F.concat(c["ends"], F.array(F.size(p["body"])))
            return F.transform(c["begins"], lambda a, k: F.array_join(F.concat(p["head"], F.slice(p["body"], a + 1, ends[k] - a)), "\n"))

        return _let(cuts(F.transform(p["body"], F.length), F.length(F.array_join(p["head"], "\n"))), join)

    def parts(t: Column, n: Column) -> Column:
        lines, title = markdown_rows(t), header_text(t)
        head = F.concat(F.when(title != "", F.array(F.concat(F.lit("Table header: "), title))).otherwise(F.array().cast("array<string>")), F.slice(lines, 1, n))
        body = F.when(F.size(t) > n, F.slice(lines, n + 1, F.size(t))).otherwise(F.slice(lines, n, 1))
        return _let(F.struct(head.alias("head"), body.alias("body")), pieces)

    made = _let(rows, lambda t: _let(header_rows(t), lambda n: parts(t, n)))
    return F.filter(F.when(F.size(rows) > 0, made).otherwise(F.array().cast("array<string>")), lambda p: F.length(p) >= least)


def interleaved(html: Column) -> Column:
    """The text of a page with each table in its place as Markdown."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<ix:hidden\b.*?</ix:hidden>", " ")
    # the n + 1 texts between n tables, then the tables
    read = pages(_let(bare, lambda b: F.concat(F.split(b, TABLE), _all(b, TABLE))))

    def part(p: Column, k: Column) -> Column:
        table = F.get(matrices(F.get(p, F.floor(F.size(p) / 2).cast("int") + 1 + k)["tables"]), F.lit(0))
        return F.array(many_lines(p[k]["text"]), _let(table, lambda t: F.when(F.size(t) > 0, F.concat(F.lit("Markdown table:\n"), markdown(t))).otherwise("")))

    whole = _let(read, lambda p: F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int")), lambda k: part(p, k))))
    return many_lines(F.array_join(F.filter(whole, lambda x: x != ""), "\n\n"))


# -- sections and periods
def sections(text: Column) -> Column:
    """(item, title, content) of each headed part, and of what precedes the first."""
    until = rf".*?(?={ITEM_HEADING}|\z)"
    named = lambda item, title, content: F.struct(item.alias("item"), title.alias("title"), content.alias("content"))
    group = lambda part, i: F.regexp_extract(part, f"(?iU)^{ITEM_HEADING}", i)

    def cut(t: Column, parts: Column) -> Column:
        # without a heading the text stays as it is
        preface = F.when(F.size(parts) > 0, strip(F.regexp_extract(t, f"(?isU)^({until})", 1))).otherwise(t)
        headed = F.transform(parts, lambda part: named(F.concat(F.lit("Item "), F.upper(group(part, 1))), one_line(group(part, 2)), strip(part)))
        return F.filter(F.concat(F.array(named(F.lit(""), F.lit(""), preface)), headed), lambda s: s["content"] != "")

    return _let(text, lambda t: _let(_all(t, f"(?isU){ITEM_HEADING}{until}"), lambda parts: cut(t, parts)))


def last_item(text: Column) -> Column:
    """(item, title) of a text's last heading; empty strings without one."""
    last = F.coalesce(F.try_element_at(_all(text, f"(?iU){ITEM_HEADING}"), F.lit(-1)), F.lit(""))
    item, title = (F.regexp_extract(last, f"(?iU)^{ITEM_HEADING}", i) for i in (1, 2))
    return F.struct(F.when(item != "", F.concat(F.lit("Item "), F.upper(item))).otherwise("").alias("item"), one_line(title).alias("title"))


def periods(text: Column) -> Column:
    """(periods, years, primary) in order of pattern and place, without repeats whatever their case."""
    found = F.concat(*[F.transform(_all(text, f"(?iU){p}"), one_line) for p in (PERIOD_DATE, PERIOD_SPAN, PERIOD_FY, PERIOD_FISCAL)])
    lower = lambda f: F.struct(f.alias("f"), F.transform(f, F.lower).alias("low"))
    first = _let(_let(found, lower), lambda s: F.transform(F.array_distinct(s["low"]), lambda v: F.element_at(s["f"], F.array_position(s["low"], v).cast("int"))))

    def named(f: Column) -> Column:
        years = F.array_distinct(_all(F.when(F.size(f) > 0, F.array_join(f, " ")).otherwise(text), r"(?U)\b20\d{2}\b"))
        own = F.when(F.size(f) > 0, f).otherwise(years)
        return F.struct(F.slice(own, 1, 12).alias("periods"), F.slice(years, 1, 8).alias("years"), F.coalesce(F.get(own, F.lit(0)), F.lit("")).alias("first"))

    return _let(first, named)


def around(html: Column, begin: Column, end: Column) -> Column:
    """[before, after]: the texts of what lies before and after a place of a page (offsets from 0), as far as LOOK_BACK."""
    start = F.greatest(F.lit(0), begin - LOOK_BACK)
    read = pages(F.array(F.substr(html, start + 1, begin - start), F.substr(html, end + 1, F.lit(LOOK_BACK))))
    return F.transform(read, lambda p: many_lines(p["text"]))


def table_context(texts: Column, tokens: int = 200) -> Column:
    """(before, after): the last tokens of the text before a place, and the first of the text after it."""
    found = lambda i: _all(texts[i], f"(?U){CONTEXT_TOKEN}")
    before = _let(found(0), lambda t: F.slice(t, F.greatest(F.lit(1), F.size(t) - tokens + 1), tokens))
    return F.struct(F.array_join(before, " ").alias("before"), F.array_join(F.slice(found(1), 1, tokens), " ").alias("after"))


# -- windows and tokens
def parent_windows(children: Column, most: int = 6000) -> Column:
    """Of each child: it and its neighbours, joined by blank lines and cut to `most` characters.

    Neighbours are tried outwards, left and right in turn, and each that fits is taken with all between; the search ends
    once neither of a turn fits or both ends are reached. As each turn takes one that fits, `most` bounds the turns.
    """
    def reach(i: Column, lens: Column, turns: Column) -> Column:
        def step(s: Column, d: Column) -> Column:
            size = lambda j: F.get(lens, j) + 2
            left = F.coalesce(~s["done"] & (i - d >= 0) & (s["total"] + size(i - d) <= most), F.lit(False))
            total = F.when(left, s["total"] + size(i - d)).otherwise(s["total"])
            right = F.coalesce(~s["done"] & (total + size(i + d) <= most), F.lit(False))
            return F.struct(F.when(left, i - d).otherwise(s["lo"]).alias("lo"), F.when(right, i + d).otherwise(s["hi"]).alias("hi"), F.when(right, total + size(i + d)).otherwise(total).alias("total"), (s["done"] | ~(left | right)).alias("done"))

        start = F.struct(i.alias("lo"), i.alias("hi"), lens[i].alias("total"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), turns), start, step)

    def text(c: Column, r: Column) -> Column:
        whole = strip(F.array_join(F.slice(c, r["lo"] + 1, r["hi"] - r["lo"] + 1), "\n\n"))
        return F.when(F.length(whole) <= most, whole).otherwise(F.regexp_replace(F.substring(whole, 1, most), r"(?U)\s+\z", ""))

    def each(c: Column) -> Column:
        turns = lambda lens: F.greatest(F.lit(1), F.least(F.size(lens) - 1, F.floor(F.lit(most) / (F.array_min(lens) + 2)).cast("int") + 1))
        facts = lambda lens: F.struct(lens.alias("lens"), turns(lens).alias("turns"))
        return _let(_let(F.transform(c, F.length), facts), lambda f: F.transform(c, lambda _, i: _let(reach(i, f["lens"], f["turns"]), lambda r: text(c, r))))

    return _let(children, lambda c: F.when(F.size(c) > 0, each(c)).otherwise(c))


def _tokens(text: Column) -> Column:
    """(lead, tokens): what precedes the first token, and tokens, each with what follows it up to the next."""
    return F.struct(F.regexp_extract(text, f"(?U)^{BETWEEN}", 0).alias("lead"), _all(text, f"(?U){CONTEXT_TOKEN}{BETWEEN}").alias("tokens"))


def token_pieces(text: Column, most: int) -> Column:
    """A text in pieces of `most` context tokens, cut before a token; all characters are kept but outer white space."""
    def cut(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(t["tokens"]) - 1) / most).cast("int"))
        piece = lambda p: strip(F.concat(F.when(p == 0, t["lead"]).otherwise(""), F.array_join(F.slice(t["tokens"], p * most + 1, most), "")))
        return F.filter(F.transform(F.sequence(F.lit(0), last), piece), lambda x: x != "")

    return _let(_tokens(F.coalesce(text, F.lit(""))), cut)


def trim_to_tokens(text: Column, most: int = 384) -> Column:
    """The longest prefix of at most `most` context tokens, within three characters a token."""
    near = F.substring(text, 1, 3 * most)
    cut = lambda t: F.regexp_replace(F.concat(t["lead"], F.array_join(F.slice(t["tokens"], 1, most), "")), rf"(?U){BETWEEN}\z", "")
    return _let(_tokens(near), lambda t: F.when(F.size(t["tokens"]) <= most, F.regexp_replace(near, r"(?U)\s+\z", "")).otherwise(cut(t)))


# -- operators
def html_chunks(df: DataFrame, key: str = "page_id", html: str = "html", size: int = 1400, overlap: int = 180, least: int = 120, parent: int = 6000) -> DataFrame:
    """(key, chunk_index, chunk_type, item, content, parent_context) of each page: text by sections, tables by rows.
    Null html gives no rows. Extra columns aren't read."""
    chunk = lambda kind, item, content: F.struct(F.lit(kind).alias("kind"), item.alias("item"), content.alias("content"))
    read = df.select(F.col(key), page(F.col(html)).alias("p")).select(key, sections(many_lines(F.col("p.text"))).alias("s"), matrices(F.col("p.tables")).alias("t"))
    cut = with_windows(read.select(key, "s", "t", F.transform("s", lambda s: many_lines(s["content"])).alias("texts")), "texts", size, overlap, least)
    texts = F.flatten(F.transform("s", lambda s, i: F.transform(F.col("windows")[i], lambda c: chunk("text", s["item"], c))))
    tables = F.flatten(F.transform("t", lambda t: F.transform(table_chunks(t, size), lambda c: chunk("table", F.lit(""), c))))
    made = cut.select(key, F.concat(texts, tables).alias("chunks"))
    whole = made.select(key, "chunks", parent_windows(F.col("chunks.content"), parent).alias("parents"))
    return exploded(whole, F.col("chunks"), "chunk_index", "c").select(key, "chunk_index", F.col("c.kind").alias("chunk_type"), "c.item", "c.content", F.col("parents")[F.col("chunk_index")].alias("parent_context"))


def text_windows(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1400, overlap: int = 180, least: int = 120) -> DataFrame:
    """(key, windows) of each document; null is empty."""
    texts = df.select(F.col(key), F.array(many_lines(F.coalesce(F.col(text), F.lit("")))).alias("texts"))
    return with_windows(texts, "texts", size, overlap, least).select(key, F.col("windows")[0].alias("windows"))


def text_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1400, overlap: int = 180, least: int = 120) -> DataFrame:
    """(key, chunk_index, content) of each document's windows."""
    return exploded(text_windows(df, key, text, size, overlap, least), F.col("windows"), "chunk_index", "content").select(key, "chunk_index", "content")


def paper_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3000, overlap: int = 300, parent: int = 6000) -> DataFrame:
    """(key, section_index, chunk_index, parent, content): sections part at blank lines, a section's first `parent`
    characters are the parent, and children are cut from that parent, so that each child lies in its parent."""
    size = max(300, size)
    body = F.split(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r"), F.lit("\n")), r"(?U)\n\s*\n")
    parents = df.select(F.col(key), F.transform(body, lambda b: F.substring(many_lines(b), 1, parent)).alias("parents"))
    cut = with_windows(parents, "parents", size, min(overlap, size // 2), 1, (". ", "\n"))
    child = lambda s, p, c: F.struct(s.alias("section_index"), p.alias("parent"), c.alias("content"))
    children = F.flatten(F.transform("parents", lambda p, s: F.transform(F.col("windows")[s], lambda c: child(s, p, c))))
    return exploded(cut, children, "chunk_index", "c").select(key, "c.section_index", "chunk_index", "c.parent", "c.content")
