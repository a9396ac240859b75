"""The two steps of chunking that have no column functions: reading HTML, and windows whose begin hangs on the end of the
one before. Both work on Arrow batches of arrays of texts; all else of chunking is in chunking.py."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from html.parser import HTMLParser
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_SKIP = {"script", "style", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "td", "th", "title"}
_PAGES = pa.list_(pa.struct([("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string()))))]))


#: Tags and references that can be read in one way only; a page of others is left to the parser.
_TAG = re.compile(r"""<(/?[a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[A-Za-z0-9.#%:_-]+))?)*[ \t\n]*)>""")
_REFERENCE = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{0,29}|#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,9});")
_RAW = {"script", "style"}


class _Events(HTMLParser):
    """(tag, hidden, text after it) of a page; end tags begin with a slash."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append((tag, any(k == "hidden" or k == "style" and "display:none" in (v or "").replace(" ", "") for k, v in attrs), ""))

    def handle_endtag(self, tag):
        self.events.append(("/" + tag, False, ""))

    def handle_data(self, data):
        self.events.append(("", False, data))


def _events(html: str):
    """What the parser would give, a multiple faster where all of a page's tags and references are plain ones."""
    parts = _TAG.split(html)
    tags = [t.lower() for t in parts[1::3]]
    attrs = "".join(parts[2::3]).lower()
    plain = html.count("<") == len(tags) and "hidden" not in attrs and "style" not in attrs and ("&" not in html or html.count("&") == len(_REFERENCE.findall(html)))
    # a script ends at its own end tag only
    if plain and all(tags[i + 1 : i + 2] == ["/" + t] for i, t in enumerate(tags) if t in _RAW):
        texts = parts[::3]
        return zip(["", *tags], repeat(False), [unescape(t) if "&" in t else t for t in texts] if "&" in html else texts)
    p = _Events()
    p.feed(html)
    p.close()
    return p.events


def _page(html: str | None) -> dict:
    """Text with line ends at block tags, and tables as rows of cells; skipped regions nest properly."""
    out, tables, skip, row, cell = [], [], [], None, None
    for tag, hidden, data in _events(html or ""):
        if tag[:1] == "/":
            name = tag[1:]
            if skip:
                if name in skip:
                    del skip[len(skip) - 1 - skip[::-1].index(name) :]
            else:
                if name in _BLOCK:
                    out.append("\n")
                if name in ("td", "th"):
                    if cell is not None and row is not None:
                        row.append(" ".join("".join(cell).split()))
                        cell = None
                elif name == "tr" and row is not None and tables:
                    tables[-1].append(row)
                    row = None
        elif tag:
            if tag not in _VOID and (skip or hidden or tag in _SKIP):
                skip.append(tag)
            if not skip:
                if tag in _BLOCK:
                    out.append("\n")
                if tag == "table":
                    tables.append([])
                elif tag == "tr" and tables:
                    row = []
                elif tag in ("td", "th") and row is not None:
                    cell = []
        if data and not skip:
            out.append(data)
            if cell is not None:
                cell.append(data)
    return {"text": "".join(out), "tables": tables}


@arrow_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))])))
def pages(pieces: pa.Array) -> pa.Array:
    """Of each piece of HTML its text, as it stands between tags, and its tables as rows of cells of any number."""
    return pa.array([x and [_page(h) for h in x] for x in pieces.to_pylist()], _PAGES)


@arrow_udf(T.StringType())
def page_text(html: pa.Array) -> pa.Array:
    """The text of a page, as it stands between tags; null is empty."""
    return pa.array([_page(h)["text"] for h in html.to_pylist()], pa.string())


@arrow_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def page_tables(html: pa.Array) -> pa.Array:
    """The tables of a page as rows of cells of any number; null has none."""
    return pa.array([_page(h)["tables"] for h in html.to_pylist()], _PAGES.value_type.field("tables").type)


def spans(text: str, size: int, overlap: int, marks: tuple[str, ...]) -> list[tuple[int, int]]:
    """Begin and end of windows of `size` characters that overlap.

    First all places are found at which a window may end, each after a mark's first character; then windows step over
    them: one ends at the last place of a mark that lies in it whole, if that is in its second half, else at its full
    size. The next begins `overlap` before that end, but always further on.
    """
    places = sorted((m.end(), m.start() + 1) for mark in marks for m in re.finditer(re.escape(mark), text))
    whole, after = [p[0] for p in places], [p[1] for p in places]
    longest = max(map(len, marks), default=0)
    out, begin = [], 0
    while begin < len(text):
        end = begin + size
        if end >= len(text):
            out.append((begin, len(text)))
            break
        k = bisect_right(whole, end)
        # of marks of other lengths, the last few that lie in the window have its last place
        best = max(after[max(0, k - len(marks) * longest) : k], default=0)
        stop = best if best > begin + size // 2 + 1 else end
        out.append((begin, stop))
        begin = max(begin + 1, stop - overlap)
    return out


def with_windows(df: DataFrame, texts: str, size: int = 1400, overlap: int = 180, least: int = 1, marks: tuple[str, ...] = ("\n", ". ", " ")) -> DataFrame:
    """df with `windows`: an array for each of the array `texts`, its windows, stripped, without those of fewer than
    `least` characters. A step of its own: as a column function, the optimizer may put it into another one's lambda, where
    it can't run."""
    def cut(text: str | None) -> list[str]:
        found = ((text or "")[a:b].strip() for a, b in spans(text or "", size, overlap, marks))
        return [c for c in found if len(c) >= max(1, least)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [x and [cut(t) for t in x] for x in part.column(texts).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.list_(pa.string())))], names=[*part.schema.names, "windows"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("windows", T.ArrayType(T.ArrayType(T.StringType())))]))
