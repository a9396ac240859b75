"""Tokenizers, normalisers and predicates of text, as Column functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that define the results.
SEARCH_PATTERN = r"[A-Za-z][A-Za-z0-9&.-]*|\d+(?:,\d{3})*(?:\.\d+)?%?"
PAPER_PATTERN = r"[A-Za-z][A-Za-z0-9_.-]*|\d+(?:,\d{3})*(?:\.\d+)?%?"
CONTEXT_PATTERN = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?|[^\p{L}\p{N}_\s]"
SEARCH_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "calculate", "does", "for", "from", "how", "in", "include", "is", "of", "on", "or", "the", "to", "using", "was", "were", "what", "which", "with", "year", "ended", "fiscal"]
PAPER_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "paper", "study", "that", "the", "this", "to", "was", "were", "what", "which", "with"]
STRIPPED = ".,;:()[]{}"
FISCAL_YEAR = r"20\d{2}"
NUMERIC_QUESTION = r"(?i)(how many|how much|accuracy|f1|bleu|rouge|percent|percentage|number|count|score)"


def _extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def search_matches(text: Column) -> Column:
    """What the search pattern finds, before search_token; null for a null text."""
    return _extract(F.lower(text), SEARCH_PATTERN)


def search_token(match: Column, stopwords: list[str] = SEARCH_STOPWORDS) -> Column:
    """The token of a match: outer punctuation stripped, commas removed; null for stop words and what nothing is left of.
    For matches in rows of their own; search_tokens is the same for arrays."""
    t = F.trim(match, F.lit(STRIPPED))
    return F.when((t != "") & ~t.isin(stopwords), F.replace(t, F.lit(","), F.lit("")))


def search_tokens(text: Column, stopwords: list[str] = SEARCH_STOPWORDS) -> Column:
    """Lower-cased words and numbers, outer punctuation stripped, stop words dropped, commas removed. Null gives null."""
    words = F.transform(_extract(F.lower(text), SEARCH_PATTERN), lambda t: F.trim(t, F.lit(STRIPPED)))
    return F.transform(F.filter(words, lambda t: (t != "") & ~t.isin(stopwords)), lambda t: F.replace(t, F.lit(","), F.lit("")))


def paper_tokens(text: Column) -> Column:
    return F.filter(_extract(F.lower(text), PAPER_PATTERN), lambda t: ~t.isin(PAPER_STOPWORDS))


def context_tokens(text: Column) -> Column:
    """Words (with one inner hyphen or apostrophe) and single punctuation marks."""
    return _extract(text, CONTEXT_PATTERN)


def qa_tokens(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(bare, r"\s+"), lambda t: (t != "") & ~t.isin("a", "an", "the"))


def char_token_estimate(text: Column) -> Column:
    """CJK characters count one each, four others count one; at least 1."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, "[一-鿿]", ""))
    return F.greatest(F.lit(1), cjk + F.round((F.length(text) - cjk) / 4.0).cast("int"))


def clean_line(text: Column) -> Column:
    """Runs of white space are one blank, ends trimmed. Single blanks, most of what there is, are no match."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s{2,}|[\t\n\x0B\f\r]", " "))


def clean_lines(text: Column) -> Column:
    """Runs of blanks and tabs are one blank, blank lines at most one, ends trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def truncate_end(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 24)), F.lit(mark)))


def truncate_middle(text: Column, most: int, mark: str = "\n...\n") -> Column:
    head = int(most * 0.6)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(most - head))))


def normalized_answer(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.%]+", " "))


def item_reference(text: Column) -> Column:
    """'Item 7A' for the first item that the text names, else the empty string."""
    found = F.regexp_extract(text, r"(?i)\bitem\s+(\d+[a-z]?)\b", 1)
    return F.when(found == "", "").otherwise(F.concat(F.lit("Item "), F.upper(found)))


def json_object(text: Column) -> Column:
    """What stands between the first { and the last }."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def numeric_question(text: Column) -> Column:
    return text.rlike(NUMERIC_QUESTION)


def decimal_value(text: Column) -> Column:
    """The first number of a text: commas dropped, '(1,234)' negative, blanks inside '$ 49. 63' tolerated; else null."""
    raw = F.regexp_extract(text, r"\(?\s*-?\s*\$?\s*\d[\d,]*(?:\.\s*\d+)?\s*\)?", 0)
    number = F.regexp_replace(raw, r"[^\d.-]", "").try_cast("decimal(20,6)")
    return F.when(raw.rlike(r"^\(.*\)$"), -number).otherwise(number)


def scale_name(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("billion"), "billion").when(low.contains("million"), "million").when(low.contains("thousand"), "thousand").otherwise("unit")


def scale_factor(scale: Column) -> Column:
    return F.when(scale == "billion", 1_000_000_000).when(scale == "million", 1_000_000).when(scale == "thousand", 1_000).otherwise(1).cast("decimal(20,0)")


#: The first rung whose words a question has is its intent.
INTENTS = [
    ("comparison", ["compare", "vs", "change", "increase", "decrease", "相比", "变化"]),
    ("calculation", ["ratio", "margin", "calculate", "difference", "计算"]),
    ("risk_factor", ["risk"]),
    ("segment_breakdown", ["segment"]),
]


def intent(text: Column) -> Column:
    """The first rung of INTENTS that the text meets, else factual_metric."""
    from .answers import any_of

    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("factual_metric")
    for name, words in reversed(INTENTS):
        out = F.when(any_of(low, words), name).otherwise(out)
    return out


def fiscal_years(text: Column, first: int = 2022, last: int = 2024) -> Column:
    """Distinct years of a range that aren't part of a longer number, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)20\d{2}(?!\d)"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y >= first) & (y <= last)))


#: Phrases of filings that are no names, and the names by which companies are called.
NO_NAMES = ["financial condition", "management discussion", "annual report"]
COMPANY_ALIASES = [
    ("apple", "AAPL"), ("microsoft", "MSFT"), ("nvidia", "NVDA"), ("netflix", "NFLX"), ("meta", "META"), ("facebook", "META"), ("amd", "AMD"), ("eli lilly", "LLY"), ("lilly", "LLY"), ("merck", "MRK"),
    ("pfizer", "PFE"), ("starbucks", "SBUX"), ("american express", "AXP"), ("linde", "LIN"), ("prologis", "PLD"), ("welltower", "WELL"), ("exelon", "EXC"), ("american electric power", "AEP"),
    ("consolidated edison", "ED"), ("xcel energy", "XEL"), ("valero", "VLO"), ("amazon", "AMZN"), ("google", "GOOGL"), ("alphabet", "GOOGL"), ("jpmorgan", "JPM"), ("berkshire", "BRK-B"), ("tesla", "TSLA"),
    ("coca-cola", "KO"), ("coca cola", "KO"), ("walmart", "WMT"),
]


def named_entities(text: Column) -> Column:
    """Names of two to four capitalised words, on one line, each once in either case; phrases of NO_NAMES are none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){1,3})(?![\p{L}\p{N}_])"), F.lit(1)), clean_line)
    names = F.filter(found, lambda n: ~F.exists(F.array(*[F.lit(x) for x in NO_NAMES]), lambda x: F.lower(n).contains(x)))
    low = F.transform(names, F.lower)
    return F.filter(names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)


def search_keywords(header: Column, content: Column, most: int = 80) -> Column:
    return F.slice(F.array_distinct(search_tokens(F.concat_ws(" ", header, content))), 1, most)


def or_query(text: Column, most: int = 16) -> Column:
    """Distinct alphanumeric tokens joined with | for a full-text search."""
    return F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), 1, most), " | ")


def canonical_item(label: Column, modality: Column, content: Column, section: Column | None = None) -> Column:
    """The item of a row: an auditor's report is Item 8; what isn't text keeps its label; an unlabelled introduction of
    management's discussion and analysis is Item 7; else the item that section and opening name, else the label."""
    low = F.lower(clean_line(F.concat_ws(" ", section if section is not None else F.lit(""), F.substring(content, 1, 2400))))
    opinion = low.contains("opinion on the financial statements") | low.contains("opinions on the financial statements") | (low.contains("in our opinion") & low.contains("present fairly"))
    report = low.contains("report of independent registered public accounting firm") & opinion
    formal = low.contains("pcaob") & low.contains("internal control over financial reporting") & (opinion | low.contains("our responsibility is to express opinions"))
    discussion = (low.contains("management's discussion") | low.contains("management’s discussion") | low.contains("management discussion") | low.contains("md&a")) & low.contains("analysis")
    named = item_reference(F.concat_ws(" ", section if section is not None else F.lit(""), F.substring(content, 1, 280)))
    return F.when(report | formal, "Item 8").when((label != "") & (modality != "text"), label).when((label == "") & discussion, "Item 7").when(named != "", named).otherwise(label)


def _with(values: dict[str, Column], of) -> Column:
    """of(row) with the values made once for each row, however often it uses them: a lambda's body is evaluated as it is
    written, and makes anew what it doesn't take from its argument."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), of)[0]


def centred_window(text: Column, query: Column, most: int) -> Column:
    """At most `most` characters of a text around the longest of the query's words (five letters or more, the first of
    equal ones) that it has, a third of them before it, cut at white space and marked with dots where something is left
    out. Texts that fit are whole; without such a word the window is at the start."""
    spaced = r"(?s)\A.*\s"  # up to the last white space, in one pass

    def around(v: Column) -> Column:
        # the words from the longest on, so that mostly one is looked for
        anchor = F.aggregate(v.words, F.lit(""), lambda best, w: F.when(best != "", best).when(v.low.contains(w.word), w.word).otherwise(best))
        at = F.greatest(F.instr(v.low, anchor) - 1, F.lit(0))
        return _with({"t": v.t, "n": v.n, "start": F.least(F.greatest(F.lit(0), at - most // 3), v.n - most)}, spread)

    def spread(v: Column) -> Column:
        # the word that the window would cut at its start is taken in whole, the one at its end is left out
        back = v.start - F.length(F.regexp_extract(F.substring(v.t, F.lit(1), v.start), spaced, 0))
        return _with({"t": v.t, "n": v.n, "end": v.start + most, "back": back}, cut)

    def cut(v: Column) -> Column:
        start = v.end - most - v.back
        inside = F.substring(v.t, start + 1, F.lit(most) + v.back)
        right = F.when(v.end < v.n, F.regexp_extract(inside, spaced, 0)).otherwise(inside)
        window = F.concat(F.when(start > 0, "... ").otherwise(""), F.trim(right), F.when(v.end < v.n, " ...").otherwise(""))
        return _with({"w": window}, lambda x: F.when(F.length(x.w) <= most, x.w).otherwise(F.concat(F.rtrim(F.substring(x.w, 1, most - 4)), F.lit(" ..."))))

    def whole(v: Column) -> Column:
        words = F.filter(F.array_distinct(search_tokens(v.q)), lambda w: F.length(w) >= 5)
        ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("word"))))
        return F.when(v.n <= most, v.t).otherwise(_with({"t": v.t, "n": v.n, "low": F.lower(v.t), "words": ranked}, around))

    t = F.trim(F.coalesce(text, F.lit("")))
    return _with({"t": t, "q": F.coalesce(query, F.lit(""))}, lambda v: _with({"t": v.t, "n": F.length(v.t), "q": v.q}, whole))


def header_lines(content: Column) -> Column:
    """The lines of a row that are a table's header."""
    return F.array_join(F.filter(F.split(content, "\n"), lambda x: F.lower(x).startswith("table header:")), "\n")


def metric_rows(content: Column, metric: Column) -> Column:
    """The rows of a table whose first cell names the metric."""
    from .answers import metrics_agree

    first = lambda x: F.regexp_extract(x, r"^\|\s*([^|]+?)\s*\|", 1)
    return F.array_join(F.filter(F.split(content, "\n"), lambda x: x.startswith("|") & metrics_agree(metric, first(x))), "\n")
