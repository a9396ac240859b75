"""The reader of plain pages against the parser."""

import random

import pytest

from sievemark.functions import markup

PARTS = (
    "<p>|</p>|<div hidden>|</div>|<table class='x'>|<table>|</table>|<tr>|</tr>|<td>|<td a=1>|</td>|<th>|</th>|a\\b|&amp;|&lt;b|&am|p;|&#65;| x  y |<br>|<br/>|<script>|</script>|<style>|</style>|<noscript>|"
    "</noscript>|<img hidden>|<b>|</b>|<|<!-- x -->|&|1 > 0|<p style='display: none'>|\n|&copy|<TD>|</ td>|<a b='c>d'>|<script|é"
).split("|")
PLAIN = [p for p in PARTS if p not in ("<", "<!-- x -->", "&", "&am", "&lt;b", "&copy", "<br/>", "</ td>", "<script", "<a b='c>d'>", "<div hidden>", "<img hidden>", "<p style='display: none'>")]


def parsed(html, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(markup, "_TAG", markup.re.compile("(?!)()()"))
        return markup._page(html)


@pytest.mark.parametrize("parts", [PARTS, PLAIN])
def test_reader(parts, monkeypatch):
    r, quick = random.Random(7), 0
    for _ in range(3000):
        html = "".join(r.choice(parts) for _ in range(r.choice([0, 3, 8, 20, 40])))
        quick += isinstance(markup._events(html), zip)
        assert markup._page(html) == parsed(html, monkeypatch), html
    assert quick > (1000 if parts is PLAIN else 50)


def test_filing_needs_no_parser(monkeypatch):
    def fail(*_):
        raise AssertionError("parsed")

    monkeypatch.setattr(markup._Events, "feed", fail)
    html = "<html><head><style>p{}</style></head><body><p>A</p><table class='x'><tr><th>M</th></tr><tr><td>a|b &amp; <b>5</b></td></tr></table></body></html>"
    assert markup._page(html)["tables"] == [[["M"], ["a|b & 5"]]]
