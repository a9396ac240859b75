"""License scans: texts are aligned with licence templates by patience, and the templates' coverage is measured."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts

#: Least share of a template's words that must be aligned.
COVERAGE = 0.8
#: A region is searched whose words number this many times the template's, so that insertions fit in.
STRETCH = 1.5
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], rising in both.

    Anchors are items that occur once in a and once in b; of those the longest increasing subsequence is kept, and the
    gaps between are aligned in the same way. In a gap without anchors, equal items at its ends are aligned.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where: dict = {}
        for i in range(a0, a1):
            where[a[i]] = -1 if a[i] in where else i
        there: dict = {}
        for j in range(b0, b1):
            there[b[j]] = -1 if b[j] in there else j
        pairs = [(i, there[w]) for w, i in where.items() if i >= 0 and there.get(w, -1) >= 0]
        anchors = _increasing(sorted(pairs))
        if not anchors:
            continue
        last = (a0, b0)
        for i, j in anchors:
            out.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second parts increase; pairs are sorted by their distinct first parts."""
    tops, ends, back = [], [], [0] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = ends[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage, self.known = coverage, {}
        self.templates = [(name, [w.lower() for w in _WORD.findall(text)]) for name, text in sorted(templates.items())]
        self.templates = [t for t in self.templates if t[1]]
        for _, words in self.templates:
            for w in words:
                self.known.setdefault(w, len(self.known) + 1)
        self.member = np.zeros((len(self.templates), len(self.known) + 1), np.int32)
        for t, (_, words) in enumerate(self.templates):
            self.member[t, [self.known[w] for w in words]] = 1
        self.fewest = min((self._need(len(w)) for _, w in self.templates), default=1)

    def _need(self, n: int) -> int:
        return max(1, int(np.ceil(self.coverage * n)))

    def windows(self, ids: np.ndarray, t: int) -> np.ndarray:
        """Starts of the windows with enough of a template's words. Nothing else can reach the coverage."""
        n = len(self.templates[t][1])
        width = int(np.ceil(STRETCH * n))
        has = np.concatenate([[0], np.cumsum(self.member[t][ids])])
        if has[-1] < self._need(n):
            return np.zeros(0, np.int64)
        starts = np.arange(len(ids) - self._need(n) + 1)
        return starts[has[np.minimum(starts + width, len(ids))] - has[starts] >= self._need(n)]

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of what is found, by place; places of one template don't overlap.

        A window is aligned at each quarter of the template's length, so that a place of up to 1.25 times that length
        lies whole in one, and a second copy can't hide the first.
        """
        where = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in where]
        ids = np.fromiter((self.known.get(w, 0) for w in words), np.int64, len(words))
        if np.count_nonzero(ids) < self.fewest:
            return []
        out = []
        for t, (name, template) in enumerate(self.templates):
            n, next_ = len(template), 0
            width = int(np.ceil(STRETCH * n))
            for s in self.windows(ids, t).tolist():
                if s < next_:
                    continue
                pairs = patience(words[s : s + width], template)
                if len(pairs) < self._need(n):
                    next_ = s + max(1, n // 4)
                    continue
                # the window that begins where the template would may hold more of it
                begin = max(s, s + pairs[0][0] - pairs[0][1])
                s, pairs = max(((x, patience(words[x : x + width], template)) for x in (s, begin)), key=lambda p: len(p[1]))
                first, end = s + pairs[0][0], s + pairs[-1][0] + 1
                out.append((where[first][0], where[end - 1][1], name, round(len(pairs) / n, 4)))
                next_ = end
        return [(name, s, e, c) for s, e, name, c in sorted(out)]


def license_scan(docs: DataFrame, templates: dict[str, str], key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Per row of docs: key, n_licenses (distinct templates), licenses (their names, comma-joined), found (array of
    name, start, end, coverage; code points of the text), best, best_coverage.

    A template is found where at least `coverage` of its words are aligned in order within a region of STRETCH times its
    length. Words are compared in lower case without punctuation. Null and empty texts and an empty set of templates
    find nothing (best and best_coverage null). Ties for best go to the first name. Rows stay one for one, null keys
    and repeated rows too. Whole texts are scanned, however long; other columns aren't read, and an empty table gives no
    rows. No shuffle; templates are sent with the code.
    """
    scanner = Scanner(templates, coverage)
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("n_licenses long, licenses string, found array<struct<name:string,start:int,end:int,coverage:double>>, best string, best_coverage double").fields])
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))

    def run(batches):
        for batch in slices(batches):
            found = [scanner.scan(x) for x in texts(batch.column(1))]
            best = [min(f, key=lambda x: (-x[3], x[0])) if f else (None, 0, 0, None) for f in found]
            names = [sorted({x[0] for x in f}) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(n) for n in names], pa.int64()), pa.array([",".join(n) for n in names], pa.string()), pa.array([[{"name": n, "start": s, "end": e, "coverage": c} for n, s, e, c in f] for f in found], kind), pa.array([b[0] for b in best], pa.string()), pa.array([b[3] for b in best], pa.float64())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(key, "n_licenses", "licenses", spans.alias("spans"), "best", "best_coverage")
