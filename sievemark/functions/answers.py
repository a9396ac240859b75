"""Bodies, numbers and scores of answers, names of metrics and plans, as Column functions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and tolerances that define the results.
REFERENCE_MARK = r"(?i)\[(?:E|F|C)\d+(?:\s*[;,]\s*(?:E|F|C)?\d+)*\]"
BARE_REFERENCE = r"(?i)\b(?:E|F|C)\d+\b"
SOURCES = r"(?is)(?:^|\n)[ \t#>*_`-]*(?:sources?|来源).*"
CALENDAR_DATE = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+20\d{2}\b"
FILING_IDENTIFIER = r"(?i)\b(?:FY\s*)?20\d{2}\b|\b(?:Item|Part|Section|Note)\s+\d+[A-Z]?(?:\.\d+)?\b|\b10-[KQ]\b"
COUNT_OF_YEARS = r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:fiscal\s+)?years?\b"
COUNT_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?%?"
ITEM = r"(?i)\bitem\s+(\d+[a-z]?)\b"
REFUSALS = [
    "insufficient evidence", "insufficient information", "cannot determine", "cannot identify", "unable to determine",
    "unable to identify", "full comparison is not possible", "full comparison cannot be completed",
    "evidence does not contain sufficient information", "未通过引用校验", "无法从当前", "无法确定",
]
#: What a number may be off: absolutely, as a percentage, relatively, and after a shift from small to thousands.
OFF, OFF_PERCENT, OFF_SHARE, OFF_SHIFTED = 0.05, 0.15, 0.001, 50.0
#: Terms that are added to a query that holds the first.
SYNONYMS = [
    ("revenue", "net sales sales revenue"),
    ("net sales", "revenue sales"),
    ("net income", "net earnings profit"),
    ("operating income", "income from operations operating profit"),
    ("total assets", "assets consolidated balance sheets"),
    ("current assets", "current assets consolidated balance sheets"),
    ("cash", "cash and cash equivalents"),
    ("liabilities", "total liabilities current liabilities"),
    ("gross margin", "gross profit net sales"),
    ("eps", "earnings per share diluted basic"),
]
#: What is added to a query on Item 7 that holds one of these phrases.
DISCUSSION_PHRASES = ["description", "financial statement item", "financial statement term"]
DISCUSSION_TERMS = "management discussion actual results financial position financial condition results of operations cash generated from operations cash flows from operations"
#: The name of a metric is that of the first rule whose groups of words are all met.
METRICS = [
    ("total cash cash equivalents short term investments", [["cash"], ["cash equivalents"], ["short term investments"]]),
    ("streaming revenue", [["net sales", "total sales", "sales revenue", "revenues", "revenue"], ["streaming"]]),
    ("total revenue", [["net sales", "total sales", "sales revenue", "revenues", "revenue"], ["total", "consolidated"]]),
    ("revenue", [["net sales", "total sales", "sales revenue", "revenues", "revenue"]]),
    ("net income change", [["net earnings", "net profit", "net income"], ["increase", "decrease", "change", "difference"]]),
    ("net income", [["net earnings", "net profit", "net income"]]),
    ("diluted earnings per share", [["earnings per share", "eps"], ["diluted"]]),
    ("basic earnings per share", [["earnings per share", "eps"], ["basic"]]),
    ("operating income", [["income from operations", "operating profit", "operating income"]]),
    ("total assets", [["total assets", "assets total"]]),
    ("income before tax", [["income before income taxes", "pre tax income", "pretax income"]]),
    ("income taxes", [["income tax expense", "income taxes"]]),
    ("age", [["age"]]),
]


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def answer_main(answer: Column) -> Column:
    """What precedes the heading of the sources; the usual entities are decoded. Null counts as empty."""
    t = F.coalesce(answer, F.lit(""))
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(mark), F.lit(char))
    return F.regexp_replace(t, SOURCES, "")


def answer_body(answer: Column) -> Column:
    """The answer on one line, without sources, references and marks of Markdown."""
    t = F.regexp_replace(F.regexp_replace(answer_main(answer), REFERENCE_MARK, " "), BARE_REFERENCE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[`*_>#|]", " "), r"\s+", " "))


def answer_numbers(answer: Column) -> Column:
    """Numbers that an answer states, each once: array of struct(value, percent). Counts of years come first, in words;
    then all numbers but those of dates, years, items and filings, in order."""
    body = answer_body(answer)
    words = F.transform(F.regexp_extract_all(body, F.lit(COUNT_OF_YEARS), F.lit(1)), lambda w: F.struct(F.array_position(F.array(*[F.lit(x) for x in COUNT_WORDS]), F.lower(w)).cast("double").alias("value"), F.lit(False).alias("percent")))
    bare = F.regexp_replace(F.regexp_replace(body, CALENDAR_DATE, ""), FILING_IDENTIFIER, "")
    stated = F.transform(F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(0)), lambda x: F.struct(F.regexp_replace(x, "[,%]", "").cast("double").alias("value"), x.endswith("%").alias("percent")))
    return F.array_distinct(F.concat(words, stated))


def numbers_agree(expected: Column, stated: Column, percent: Column) -> Column:
    """Whether a stated number is the expected one within the tolerances; beside percentages, also where one of them is
    in thousands of the other's unit."""
    near = F.greatest(F.when(percent, OFF_PERCENT).otherwise(OFF), F.abs(expected) * OFF_SHARE)
    large, small = F.abs(stated) >= 1000, F.abs(expected) < 100
    up = large & small & (F.abs(expected - stated / 1000) <= near)
    down = (F.abs(expected) >= 1000) & (F.abs(stated) < 100) & (F.abs(expected - stated * 1000) <= F.greatest(F.lit(OFF_SHIFTED), F.abs(expected) * OFF_SHARE))
    return (F.abs(expected - stated) <= near) | (~percent & (up | down))


def matched_numbers(expected: Column, stated: Column) -> Column:
    """How many expected numbers find a stated one of their own, in order, each the first that is left."""
    places = F.transform(stated, lambda y, i: F.struct(i.alias("i"), y["value"].alias("value"), y["percent"].alias("percent")))

    def take(used: Column, x: Column) -> Column:
        fits = F.filter(places, lambda y: (y["percent"] == x["percent"]) & ~F.array_contains(used, y["i"]) & numbers_agree(x["value"], y["value"], x["percent"]))
        return F.when(F.size(fits) > 0, F.array_append(used, F.get(fits, F.lit(0))["i"])).otherwise(used)

    return F.size(F.aggregate(expected, F.array().cast("array<int>"), take))


def numeric_scores(expected: Column, stated: Column) -> Column:
    """struct(precision, recall, f1) of arrays of struct(value, percent); null where nothing is expected, and where
    there is nothing that could state it (a null array)."""
    n = matched_numbers(expected, stated)
    p = F.when(F.size(stated) > 0, n / F.size(stated)).otherwise(0.0)
    r = n / F.size(expected)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.when((F.size(expected) > 0) & stated.isNotNull(), F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1")))


def refusal(answer: Column) -> Column:
    return any_of(F.lower(F.coalesce(answer, F.lit(""))), REFUSALS)


def requested_item(text: Column) -> Column:
    """'item 7a' for the first item that a text names, else the empty string."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), ITEM, 1)
    return F.when(found == "", "").otherwise(F.concat(F.lit("item "), F.lower(found)))


def expanded_query(query: Column) -> Column:
    """The query and the synonyms of what it holds, in the table's order; then, for a description in Item 7, the terms of
    management's discussion."""
    low = F.lower(query)
    discussed = F.when(low.contains("item 7") & any_of(low, DISCUSSION_PHRASES), F.lit(DISCUSSION_TERMS))
    return F.concat_ws(" ", query, *[F.when(low.contains(k), F.lit(v)) for k, v in SYNONYMS], discussed)


def metric_name(text: Column) -> Column:
    """One name for the usual ways to say a metric; others in lower case, without marks and footnote number."""
    whole = F.coalesce(text, F.lit(""))
    bare = F.when(whole.contains(")"), F.regexp_replace(whole, r"\s*\(\d+\)\s*$", "")).otherwise(whole)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9 ]", " "), " {2,}", " "))

    def ladder(p: Column) -> Column:
        out = p
        for name, groups in reversed(METRICS):
            out = F.when(reduce(lambda a, b: a & b, [any_of(p, g) for g in groups]), name).otherwise(out)
        return out

    return let(plain, ladder)


def metrics_agree(a: Column, b: Column) -> Column:
    """Equal names, or revenue and total revenue."""
    return names_agree(metric_name(a), metric_name(b))


def names_agree(a: Column, b: Column) -> Column:
    pair = lambda x, y: (x == y) | ((x == "total revenue") & (y == "revenue")) | ((x == "revenue") & (y == "total revenue"))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: pair(p["a"], p["b"]))


#: A number in a quote, and a row of a table.
QUOTED_NUMBER = r"[-+]?\d[\d,]*(?:\.[ \t]*\d+)?"
TABLE_ROW = r"(?m)^\|\s*([^|]+?)\s*\|([^\r\n]+)$"


def table_rows(text: Column) -> Column:
    """The rows of a text's tables, as they stand; a text without a bar is not searched."""
    return F.when(~text.contains("|"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(TABLE_ROW), F.lit(0)))


def _plain_decimal(number: Column) -> Column:
    """The value of what QUOTED_NUMBER matches, which has commas, blanks and tabs beside its figures and sign."""
    return F.translate(number, ", \t", "").try_cast("decimal(20,6)")


def raw_decimal(text: Column) -> Column:
    """The first number of a text: commas and blanks dropped, negative if the whole text is in brackets; else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    number = _plain_decimal(F.regexp_extract(t, QUOTED_NUMBER, 0))
    return F.when(t.startswith("(") & t.endswith(")") & (number > 0), -number).otherwise(number)


def has_number(text: Column, number: Column) -> Column:
    """Whether a text states this number."""
    all_ = F.regexp_extract_all(text, F.lit(QUOTED_NUMBER), F.lit(0))
    return F.exists(all_, lambda x: _plain_decimal(x) == number)


def scale_of_fact(raw: Column, proposed: Column, metric: Column, quote: Column, content: Column) -> Column:
    """The magnitude of a value: the word after it in the quote, where its number may be written otherwise (1,000 for
    1000); else, for a row of a table, the header's 'in millions' (per-share and percentage rows of an 'except' header are
    units); else a word in the value; else what was proposed."""
    one = lambda c: F.regexp_replace(F.lower(c), "s$", "")
    magnitude = r"\s*(thousand|million|billion)s?\b"
    all_ = F.regexp_extract_all(quote, F.lit(rf"(?i)(?<![\d,.])({QUOTED_NUMBER}){magnitude}"), F.lit(0))
    own = F.filter(all_, lambda x: raw_decimal(F.regexp_extract(x, QUOTED_NUMBER, 0)) == raw_decimal(raw))
    after = F.coalesce(F.regexp_extract(F.get(own, F.lit(0)), rf"(?i){magnitude}", 1), F.lit(""))
    header = F.lower(F.regexp_extract(content, r"(?im)^Table header:([^\r\n]+)", 1))
    unit = header.contains("except") & any_of(F.lower(metric), ["per share", "per membership", "per paying membership", "margin", "percent"])
    in_header = F.regexp_extract(header, r"\bin (thousand|million|billion)s\b", 1)
    row = F.ltrim(quote).startswith("|")
    in_raw = F.regexp_extract(raw, r"(?i)\b(thousand|million|billion)s?\b", 1)
    given = one(F.trim(proposed))
    return (
        F.when(after != "", one(after)).when(row & unit, "unit").when(row & (in_header != ""), in_header)
        .when(in_raw != "", one(in_raw)).when(given.isin("thousand", "million", "billion"), given).otherwise("unit")
    )


def direct_value(metric: Column, content: Column) -> Column:
    """Whether a text states a value of the metric: a table's row of that name with numbers; in a text without tables, a
    sentence that names the metric and has a number other than a year or an item's."""
    bare = lambda s: F.regexp_replace(s, r"(?i)\bitem\s+\d+[a-z]?|(?<![\d,.])(?:19|20)\d{2}(?![\d,]|\.\d)", "")
    ways = [(n, g) for n, gs in METRICS for g in gs[:1] if len(gs) == 1]

    def says(name: Column, sentence: Column) -> Column:
        return let(F.lower(sentence), lambda s: reduce(lambda a, b: a | b, [(name == n) & any_of(s, g) for n, g in ways]) | s.contains(name))

    def states(name: Column) -> Column:
        in_row = lambda rows: F.exists(rows, lambda r: F.regexp_extract(r, TABLE_ROW, 2).rlike(r"\d") & names_agree(name, metric_name(F.regexp_extract(r, TABLE_ROW, 1))))
        # a text that doesn't name the metric has no sentence that does, and isn't cut into sentences
        sentences = lambda t: F.split(t, r"(?<=[.!?;])\s+|\R+")
        told = lambda t: says(name, t) & F.exists(sentences(t), lambda s: says(name, s) & bare(s).rlike(r"\d"))
        return let(content, lambda t: let(table_rows(t), lambda rows: F.when(F.size(rows) > 0, in_row(rows)).otherwise(told(t))))

    return F.when((F.trim(metric) == "") | (F.trim(content) == ""), False).otherwise(let(metric_name(metric), states))
