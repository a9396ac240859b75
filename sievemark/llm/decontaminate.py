"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, raw, slices, union_all

#: A window of so many consecutive item words.
WINDOW = 13
#: A document is contaminated if at least this share of its words is hit.
COVERAGE = (1, 20)
#: Words of test items in one automaton. A larger benchmark is dealt into blocks, each with its own pass.
BLOCK_WORDS = 250_000
#: Bytes that an automaton takes for each of its items' words at most, in the driver and in each worker (tests measure it).
BYTES_PER_WORD = 400

# Word characters: 0-9, A-Z as a-z, a-z, and everything outside ASCII. Other bytes part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def spans_of_words(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of each word."""
    return [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]


class Automaton:
    """Generalised suffix automaton: the states are the distinct sets of end positions of word runs of all items.

    States lie in arrays of 32-bit numbers. Most have one transition (`word`, `to`); the others of a state are in `more`.
    Item sets are kept once each and named by number, so that a block takes about BYTES_PER_WORD bytes a word.

    `long` of a state: items that have a window ending there (all items with a run of the window's length); `short`:
    items that are themselves that run when they are shorter than a window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.size = array("i", [-1]), array("i", [0])
        ends, whose = array("i"), array("i")
        short: list[tuple[int, int, int]] = []
        self.names = [name for name, _ in items]
        for item, (_, seq) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in seq]
            last = 0
            for c in ids:
                last = self._add(last, c)
                if len(ids) >= window:
                    ends.append(last)
                    whose.append(item)
            if 0 < len(ids) < window:
                short.append((last, len(ids), item))
        # items of a state: those of the states whose suffix links lead to it; a set is kept once and named by number
        self.sets: list[tuple[int, ...]] = [()]
        known: dict[tuple[int, ...], int] = {(): 0}
        self.long = array("i", bytes(4 * len(self.size)))
        for state, item in zip(ends, whose):
            while state > 0 and self.size[state] >= window and item not in self.sets[self.long[state]]:
                own = tuple(sorted((*self.sets[self.long[state]], item)))
                if own not in known:
                    known[own] = len(self.sets)
                    self.sets.append(own)
                self.long[state] = known[own]
                state = self.link[state]
        self.short: dict[int, list[tuple[int, int]]] = {}
        for state, n, item in short:
            # the state may have been split since: go up to the one that holds the run of n words
            while self.size[self.link[state]] >= n:
                state = self.link[state]
            self.short.setdefault(state, []).append((n, item))
        # nearest state on the chain of suffix links, itself included, that ends a short item
        self.near = array("i", [-1]) * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__) if short else ():
            self.near[state] = state if state in self.short else self.near[self.link[state]]
        self.least = min([window, *(n for _, n, _ in short)])

    def _next(self, state: int, c: int) -> int:
        if self.word[state] == c:
            return self.to[state]
        return self.more[state].get(c, -1) if state in self.more else -1

    def _set(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _new(self, size: int, link: int, word: int = -1, to: int = -1) -> int:
        for own, x in ((self.size, size), (self.link, link), (self.word, word), (self.to, to)):
            own.append(x)
        return len(self.size) - 1

    def _add(self, last: int, c: int) -> int:
        """Extends by one word; a state that exists already is used or split (generalised form)."""
        q = self._next(last, c)
        if q >= 0:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        cur = self._new(self.size[last] + 1, 0)
        p = last
        while p != -1 and self._next(p, c) < 0:
            self._set(p, c, cur)
            p = self.link[p]
        if p != -1:
            q = self._next(p, c)
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        new = self._new(self.size[p] + 1, self.link[q], self.word[q], self.to[q])
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p != -1 and self._next(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        return new

    def hits(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans that occurrences of windows cover, and the items they come from.

        Streams the words, tracking the longest run of item words that ends at each. A word that no item has sends the
        automaton to its root, so only runs of item words as long as the shortest window are walked.
        """
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        known = self.vocabulary
        mask = bytes(map(known.__contains__, seq))
        if b"\x01" * self.least not in mask:
            return spans, set()
        word, to, more, link, size, window, near = self.word, self.to, self.more, self.link, self.size, self.window, self.near
        for run in re.finditer(rb"\x01{%d,}" % self.least, mask):
            state = length = 0
            for at in range(*run.span()):
                c = known[seq[at]]
                after = to[state] if word[state] == c else more[state].get(c, -1) if state in more else -1
                while state and after < 0:
                    state = link[state]
                    length = size[state]
                    after = to[state] if word[state] == c else more[state].get(c, -1) if state in more else -1
                if after >= 0:
                    state = after
                    length += 1
                else:
                    length = 0
                cover = 0
                if length >= window:
                    s = state
                    while size[link[s]] >= window:
                        s = link[s]
                    found.update(self.sets[self.long[s]])
                    cover = window
                s = near[state]
                while s != -1:
                    for n, item in self.short[s]:
                        if n <= length:
                            found.add(item)
                            cover = max(cover, n)
                    s = near[link[s]]
                if cover:
                    start = at + 1 - cover
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at + 1))
        return spans, {self.names[i] for i in found}


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS):
    """The benchmark's items, a block of bounded size at a time; the driver holds one block."""
    block, size = [], 0
    for row in items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        seq = words((row.t or "").encode())
        if not seq:
            continue
        if block and size + len(seq) > block_words:
            yield block
            block, size = [], 0
        block.append((row.k, seq))
        size += len(seq)
    if block:
        yield block


_NEW = "n_words long, n_hit long, n_items long, items array<string>, spans array<int>, contaminated boolean"
_NAMES = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.bool_()]


def _verdict(n_words: int, spans: list[tuple[int, int]], found: set) -> tuple:
    hit = sum(b - a for a, b in spans)
    return n_words, hit, len(found), sorted(found), [y for s in spans for y in s], hit > 0 and COVERAGE[1] * hit >= COVERAGE[0] * n_words


def _scan(plain: DataFrame, kept: list[str], text: str, auto) -> DataFrame:
    """One pass of all texts by one block's automaton."""
    names, at = plain.columns, plain.columns.index(text)

    def run(batches):
        a = auto.value
        for batch in slices(batches):
            out = []
            for x in raw(batch.column(at)):
                seq = words(x)
                spans, found = a.hits(seq)
                out.append(_verdict(len(seq), spans, found - {None}))
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in kept], *[pa.array([o[i] for o in out], k) for i, k in enumerate(_KINDS)]], names=[*kept, *_NAMES])

    return plain.mapInArrow(run, T.StructType([plain.schema[c] for c in kept] + T._parse_datatype_string(_NEW).fields))


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: bool = False) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted strings), spans (word starts and ends, alternating), contaminated.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words inside
    any occurrence of a window are hit. Null or empty texts have no words and aren't contaminated. Items with a null key
    still hit, but are in no list; without items nothing is hit. Rows of docs are kept one for one, repeated rows and
    null keys too. carry=True keeps all columns of docs but those named like the new ones. Very long texts are streamed whole.

    The items are read in blocks of at most `block_words` words (a longer item is a block); each block's automaton is
    broadcast and the documents are streamed past it. With one block there is no shuffle. With more, rows are numbered
    and written once, each block makes its own pass over them, and what it hits is merged by row number.
    """
    sc = docs.sparkSession.sparkContext
    autos = [sc.broadcast(Automaton(b, window)) for b in item_blocks(items, item_key, item_text, block_words)] or [sc.broadcast(Automaton([], window))]
    plain = docs.select(*[c for c in docs.columns if c not in _NAMES]) if carry else docs.select(key, text)
    given = plain.columns if carry else [key]
    # numbered names inside, so that no column of docs clashes with those of the operator
    text = f"c{plain.columns.index(text)}"
    plain = plain.toDF(*[f"c{i}" for i in range(len(plain.columns))])
    kept = plain.columns if carry else ["c0"]
    if len(autos) == 1:
        return _scan(plain, kept, text, autos[0]).toDF(*given, *_NAMES)
    base = checkpointed(plain.withColumn("_row", F.monotonically_increasing_id()))
    first = _scan(base, [*kept, "_row"], text, autos[0])
    rest = union_all([_scan(base.select("_row", text), ["_row"], text, a).where("n_hit > 0").select("_row", "items", "spans") for a in autos[1:]])
    rest = rest.groupBy("_row").agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
    both = first.join(rest, "_row", "left").select(*kept, *_NAMES, "_items", "_spans")

    def run(batches):
        for batch in slices(batches):
            col = {c: batch.column(c).to_pylist() for c in ("n_words", "items", "spans", "_items", "_spans")}
            out = []
            for n, i, s, more_i, more_s in zip(*col.values()):
                flat = s + (more_s or [])
                out.append(_verdict(n, merged(list(zip(flat[::2], flat[1::2]))), {*i, *(more_i or [])}))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array([o[i] for o in out], k) for i, k in enumerate(_KINDS)]], names=[*kept, *_NAMES])

    return both.mapInArrow(run, T.StructType([plain.schema[c] for c in kept] + T._parse_datatype_string(_NEW).fields)).toDF(*given, *_NAMES)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_spans(found: DataFrame, text: str = "text", least_words: int = WINDOW) -> DataFrame:
    """Cuts each hit span of at least `least_words` words out of the text (found: from find(carry=True))."""
    names = found.columns
    at, sp = names.index(text), names.index("spans")

    def run(batches):
        for batch in slices(batches):
            out = []
            for x, spans, null in zip(raw(batch.column(at)), batch.column(sp).to_pylist(), batch.column(at).is_null().to_pylist()):
                if spans:
                    where, parts, last = spans_of_words(x), [], 0
                    for a, b in zip(spans[::2], spans[1::2]):
                        if b - a >= least_words:
                            parts.append(x[last : where[a][0]])
                            last = where[b - 1][1]
                    x = b"".join([*parts, x[last:]])
                out.append(None if null else x.decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return found.mapInArrow(run, found.schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
