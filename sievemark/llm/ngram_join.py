"""N-gram Jaccard join by T-occurrence search: short inverted lists are merged, long ones probed (DivideSkip)."""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, checkpointed, components, raw, slices, union_all
from .shingles import Shingler

#: Two sets link if den * intersection >= num * union, by default these.
NUM, DEN = 90, 100
#: Shingles in one group of short lists; sets and shingles that one task joins at once.
GROUP_TOKENS, BLOCK_SETS, BLOCK_TOKENS = 1_000_000, 1024, 1_000_000
#: Weight of the logarithm in DivideSkip's choice of long lists, and sets that may link above which the nearest is probed.
MU, PROBES = 0.02, 16
#: Bits of a bit map at most, and bits in a task's own maps for each shingle by which linked sets may differ.
MOST_CELLS, FINE = 1 << 17, 16
#: The longest list whose pairs are written down, pairs held at once, and sets of a longer list that are compared with all.
LIST_PAIRS, BLOCK_PAIRS, LIST_PROBES = 32, 2_000_000, 4
#: Pivots of a group that is more than one block.
PIVOTS = 16
#: Documents in which a task looks for frequent shingles at once, and how often one must occur there.
CHUNK_DOCS, CHUNK_COUNT = 2048, 4
#: Shingles that are ordered by their frequency; the others come before them. Bounds what is broadcast, not the result.
MOST_FREQUENT = 300_000
#: Sets that are broadcast at most to be joined with their texts.
MOST_BROADCAST = 500_000
#: Groups of short lists at least: a set is written once for each group that it has shingles in.
LEAST_GROUPS = 32


def need(n: int, num: int = NUM, den: int = DEN) -> int:
    """Least intersection of a set of n with any set that it links with."""
    return -(-num * n // den)


def linked(inter: int, a: int, b: int, num: int = NUM, den: int = DEN) -> bool:
    return den * inter >= num * (a + b - inter)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets, the smaller probed into the larger by binary search."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def cells_of(n: int, num: int = NUM, den: int = DEN, each: int = 4) -> int:
    """Bits in the bit map of a set of n, a power of two: `each` or more for each shingle by which linked sets may differ."""
    return min(MOST_CELLS, max(64, 1 << max(0, each * (2 * n * (den - num) // (den + num)) - 1).bit_length()))


def bit_map(s: np.ndarray, cells: int) -> np.ndarray:
    """A bit for each cell of the hash range: whether an odd number of the set's shingles is there.

    The bits in which the maps of two sets differ, the finer one folded to the other's cells, are at most the shingles
    in which the sets differ.
    """
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bit maps, a row each, folded to so many words."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


class BitMaps:
    """Sizes and bit maps of a group's sets, maps of one length in one matrix."""

    def __init__(self, n: np.ndarray, maps: list, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.n, self.width = n, np.array([memoryview(m).nbytes // 8 for m in maps])
        self.row = np.zeros(len(n), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            self.of[w] = np.frombuffer(b"".join([maps[i] for i in own.tolist()]), np.uint64).reshape(len(own), w)

    def gap(self, i: int, others: np.ndarray) -> np.ndarray:
        """Shingles by which set i and each of the others differ at least."""
        w, gap = int(self.width[i]), np.zeros(len(others), np.int64)
        width = self.width[others]
        for v in np.unique(width).tolist():
            at, m = np.flatnonzero(width == v), min(v, w)
            mine, theirs = folded(self.of[w][self.row[i]], m), folded(self.of[v][self.row[others[at]]], m)
            gap[at] = np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64)
        return gap

    def sized(self, i: int, others: np.ndarray) -> np.ndarray:
        a, b = self.n[i], self.n[others]
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def close(self, gap: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Whether sets that differ by `gap` at least and have so many shingles together may link."""
        return gap * (self.den + self.num) <= both * (self.den - self.num)

    def may_link(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others set i may link with, by size and bit map; true for every pair that links."""
        fits = self.sized(i, others)
        near = np.flatnonzero(fits)
        fits[near] = self.close(self.gap(i, others[near]), self.n[i] + self.n[others[near]])
        return fits

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of sets of fitting sizes may link."""
        fits, kind = np.zeros(len(a), bool), self.width[a] * (1 << 32) + self.width[b]
        for k in np.unique(kind).tolist():
            own, v, w = np.flatnonzero(kind == k), k >> 32, k & (1 << 32) - 1
            step = max(1, (1 << 19) // max(v, w))
            for i in range(0, len(own), step):
                at = own[i : i + step]
                x, y = folded(self.of[v][self.row[a[at]]], min(v, w)), folded(self.of[w][self.row[b[at]]], min(v, w))
                fits[at] = self.close(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), self.n[a[at]] + self.n[b[at]])
        return fits


class Labels:
    """Parts of 0..n-1 with a label for each member, kept in an array: the smaller part takes the larger one's label,
    which is a member of it."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members: dict[int, np.ndarray] = {}

    def unite(self, i: int, others: np.ndarray) -> None:
        for b in np.unique(self.of[others]).tolist():
            a = int(self.of[i])
            if a != b:
                x, y = (self.members.pop(k, None) for k in (a, b))
                x, y = np.array([a]) if x is None else x, np.array([b]) if y is None else y
                keep = a if len(x) >= len(y) else b
                self.of[y if keep == a else x] = keep
                self.members[keep] = np.concatenate([x, y])


# -- the exact join of a bounded number of sets
def divide_skip(lists: list[list[int]], t: int):
    """(member, number of lists that hold it) of all members that `t` or more of the sorted lists hold, in order.

    The L longest lists are put aside, L = t / (MU * log2(longest) + 1). The others are merged on a heap of cursors: a
    member that t - L of them hold is probed by binary search in the long ones; where fewer hold the smallest member,
    t - L - 1 cursors leave the heap and skip, by binary search, to what is then smallest.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < t:
        return
    aside = min(t - 1, int(t / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least = t - aside
    at = [0] * len(short)
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, off = heap[0][0], []
        while heap and heap[0][0] == top:
            off.append(heapq.heappop(heap)[1])
        if len(off) >= least:
            have = len(off)
            for left, x in zip(range(len(long), 0, -1), long):
                if have + left < t:
                    break
                k = bisect_left(x, top)
                have += k < len(x) and x[k] == top
            if have >= t:
                yield top, have
            for i in off:
                at[i] += 1
        else:
            while len(off) < least - 1 and heap:
                off.append(heapq.heappop(heap)[1])
            if not heap:
                return
            for i in off:
                at[i] = bisect_left(short[i], heap[0][0], at[i])
        for i in off:
            if at[i] < len(short[i]):
                heapq.heappush(heap, (short[i][at[i]], i))


def search(sets: list[np.ndarray], forest: Forest, num: int = NUM, den: int = DEN) -> None:
    """Unites all linked sets by a T-occurrence search (DivideSkip) of each among those that aren't larger.

    A set of n needs T = need(n) shingles in common with a set that isn't larger, so it links with none unless T of its
    inverted lists hold one. Lists hold sets by size; what a set is searched among are the sets of other components, as a
    link to its own says nothing new, that it may link with by size and bit map. So sets of a large group that don't link
    aren't merged and probed pair by pair. So that large groups of near copies are one component early, the set with the
    nearest bit map is probed first where there are many.
    """
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: (len(sets[i]), i))
    if len(order) < 2:
        return
    size = np.array([len(sets[i]) for i in order])
    known = BitMaps(size, [bit_map(sets[i], cells_of(len(sets[i]), num, den, FINE)) for i in order], num, den)
    label = np.array([forest.root(i) for i in order])
    index = None

    def unite(q: int, j: int) -> None:
        a, b = int(label[q]), int(label[j])
        forest.join(order[q], order[j])
        label[(label == a) | (label == b)] = forest.root(order[q])

    def inverted():
        at = np.concatenate([[0], np.cumsum(size)])
        _, token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        count = np.bincount(token)
        lists = np.repeat(np.arange(len(order)), size)[np.argsort(token, kind="stable")]
        return at, token, count, np.concatenate([[0], np.cumsum(count)]), lists

    for q in range(1, len(order)):
        n = int(size[q])
        t = need(n, num, den)
        first = int(np.searchsorted(size, t))
        near = first + np.flatnonzero(label[first:q] != label[q])
        gap = known.gap(q, near)
        may = known.close(gap, n + size[near])
        near, gap = near[may], gap[may]
        if len(near) > PROBES:
            j = int(near[gap.argmin()])
            if linked(overlap(sets[order[q]], sets[order[j]]), n, int(size[j]), num, den):
                unite(q, j)
                near = near[label[near] != label[q]]
        if not len(near):
            continue
        index = index or inverted()
        at, token, count, begin, lists = index
        mine = token[at[q] : at[q + 1]]
        mine = mine[count[mine] > 1]
        length = count[mine]
        held = lists[np.repeat(begin[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        among = np.zeros(len(order), bool)
        among[near] = True
        own = among[held]
        held, owner = held[own], np.repeat(np.arange(len(mine)), length)[own]
        cut = np.searchsorted(owner, np.arange(len(mine) + 1))
        if np.count_nonzero(np.diff(cut)) < t:
            continue
        held, cut = held.tolist(), cut.tolist()
        for j, common in divide_skip([held[a:b] for a, b in zip(cut, cut[1:])], t):
            if label[j] != label[q] and linked(common, n, int(size[j]), num, den):
                unite(q, j)


# -- tasks
_T1 = "id long, n long, c1 long, c2 long, often array<long>, times array<long>"


def _classes(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """A row for each document: its set's size and 128-bit name. Now and then a row lists a chunk's frequent shingles."""

    def run(batches):
        shingler, chunk, seen = Shingler(size), [], 0

        def frequent():
            x, c = np.unique(np.concatenate(chunk), return_counts=True)
            return x[c >= CHUNK_COUNT].view(np.int64).tolist(), c[c >= CHUNK_COUNT].tolist()

        def rows(k, n, a, b, often):
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([o[0] for o in often], pa.list_(pa.int64())), pa.array([o[1] for o in often], pa.list_(pa.int64()))], names=["id", "n", "c1", "c2", "often", "times"])

        for batch in slices(batches):
            n, a, b, often = [], [], [], []
            for s in shingler.sets_of(raw(batch.column(1))):
                name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                a.append(int.from_bytes(name[:8], "little", signed=True))
                b.append(int.from_bytes(name[8:], "little", signed=True))
                chunk.append(s)
                seen += 1
                often.append((None, None))
                if seen == CHUNK_DOCS:
                    often[-1] = frequent()
                    chunk, seen = [], 0
            yield rows(batch.column(0).to_pylist(), n, a, b, often)
        if seen:
            yield rows([None], [-1], [0], [0], [frequent()])

    return checkpointed(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, _T1))


def _order(t1: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the rank of each: rarer ones first. Only steers which lists are short."""
    counted = t1.where("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("z")).groupBy(F.col("z.often").alias("x")).agg(F.sum("z.times").alias("c"))
    top = counted.orderBy(F.desc("c"), "x").limit(MOST_FREQUENT).toPandas()
    x, c = top["x"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    by = np.argsort(x)
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((x, c))] = np.arange(len(x))
    return x[by], rank[by]


def rarest(s: np.ndarray, k: int, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The k first shingles of a sorted set: those that aren't known as frequent in their order, then the others by rank."""
    if not len(known):
        return s[:k]
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    frequent = known[at] == s
    rare = s[~frequent]
    return rare[:k] if len(rare) >= k else np.concatenate([rare, s[frequent][np.argsort(ranks[at[frequent]])[: k - len(rare)]]])


def _short_lists(docs: DataFrame, key: str, text: str, size: int, parts: int, order, num: int, den: int) -> DataFrame:
    """For each set and group of shingles the set's rarest shingles: a row (part, name, size, bit map, shingles)."""

    def run(batches):
        known, ranks = order.value
        shingler, done = Shingler(size), set()
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, s in zip(batch.column(0).to_pylist(), shingler.sets_of(raw(batch.column(1)))):
                if k is None or not len(s):
                    continue
                name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if name in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(name)
                rare = rarest(s, len(s) - need(len(s), num, den) + 1, known, ranks)
                part = ((rare >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                part, held = part[by], rare[by].tobytes()
                cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                own = (part[cut[:-1]].tolist(), int.from_bytes(name[:8], "little", signed=True), len(s), bit_map(s, cells_of(len(s), num, den)).tobytes(), [held[8 * a : 8 * b] for a, b in zip(cut, cut[1:])])
                for column, x in zip(out, own):
                    column.extend(x if isinstance(x, list) else [x] * (len(cut) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "c1", "n", "cells", "rare"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "part int, c1 long, n long, cells binary, rare binary")


def _loose(group: pa.Table, num: int, den: int) -> pa.Table:
    """Edges of a spanning forest of the sets of a group that share a short list and may link.

    Sets are numbered by size, and lists hold them so. Pairs on lists of up to LIST_PAIRS are written down, a block of
    them at a time. On longer lists a few sets are compared with all; then each set, once, with all before it on its
    lists that are of other parts: of a list whose largest part is its own only the rest.
    """
    c1, first = np.unique(group.column("c1").to_numpy(), return_index=True)
    n = group.column("n").to_numpy()[first]
    by = np.lexsort((c1, n))
    c1, n, first = c1[by], n[by], pa.array(first[by])
    known = BitMaps(n, group.column("cells").combine_chunks().take(first).to_pylist(), num, den)
    rare = [np.frombuffer(x, np.uint64) for x in group.column("rare").combine_chunks().take(first).to_pylist()]
    owner = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
    tokens = np.concatenate(rare)
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
    length = np.diff(start)
    parts = Labels(len(c1))
    kind = np.repeat(length, length)
    _tie_pairs(owner[(kind > 1) & (kind <= LIST_PAIRS)], np.repeat(np.arange(len(length)), length)[(kind > 1) & (kind <= LIST_PAIRS)], known, parts)
    _tie_lists([owner[start[i] : start[i + 1]] for i in np.flatnonzero(length > LIST_PAIRS).tolist()], known, parts)
    tied = parts.of != np.arange(len(c1))
    return pa.table({"a": c1[tied], "b": c1[parts.of[tied]]})


def _tie_pairs(owner: np.ndarray, of: np.ndarray, known: BitMaps, parts: Labels) -> None:
    """Ties what is on one list (`of`) and may link, by how far apart sets are on their lists."""
    at, held, k = np.arange(len(of)), [], 0

    def tie() -> None:
        pairs = np.unique(np.concatenate(held))
        a, b = pairs // len(known.n), pairs % len(known.n)
        near = known.pairs(a, b)
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            if parts.of[i] != parts.of[j]:
                parts.unite(i, np.array([j]))

    for far in range(1, LIST_PAIRS):
        at = at[at + far < len(of)]
        at = at[of[at + far] == of[at]]
        # a set that doesn't fit for size fits with none that is further on
        at = at[known.den * known.n[owner[at]] >= known.num * known.n[owner[at + far]]]
        if not len(at):
            break
        a, b = owner[at], owner[at + far]
        other = parts.of[a] != parts.of[b]
        held.append(a[other] * len(known.n) + b[other])
        k += len(held[-1])
        if k > BLOCK_PAIRS:
            tie()
            held, k = [], 0
    if held:
        tie()


def _tie_lists(lists: list[np.ndarray], known: BitMaps, parts: Labels) -> None:
    """Ties what is on one of the lists and may link: each set is compared once with each of another part."""
    for own in lists:
        for i in own[:: -(-len(own) // LIST_PROBES)].tolist():
            others = own[parts.of[own] != parts.of[i]]
            parts.unite(i, others[known.may_link(i, others)])
    main, rest = [], []
    for own in lists:
        label, count = np.unique(parts.of[own], return_counts=True)
        inside = parts.of[own] == label[count.argmax()]
        main.append(int(own[inside][0]))
        rest.append(own[~inside])
    among = np.zeros(len(known.n), bool)
    sets = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    on = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    by = np.argsort(sets, kind="stable")
    sets, on = sets[by], on[by]
    cut = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1], [True]])) if len(sets) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        i = int(sets[a])
        least = int(np.searchsorted(known.n, need(int(known.n[i]), known.num, known.den)))
        before = []
        for k in on[a:b].tolist():
            own = rest[k] if parts.of[main[k]] == parts.of[i] else lists[k]
            before.append(own[np.searchsorted(own, least) : np.searchsorted(own, i)])
        held = np.concatenate(before)
        held = held[parts.of[held] != parts.of[i]]
        if len(held):
            among[held] = True
            others = least + np.flatnonzero(among[least:i])
            among[held] = False
            parts.unite(i, others[known.may_link(i, others)])


def _join_block(size: int, with_pivots: bool, num: int, den: int):
    def sets_of(df: pd.DataFrame) -> list[np.ndarray]:
        return Shingler(size).sets_of([(x or "").encode() for x in df["t"]])

    def edges(ids: np.ndarray, forest: Forest) -> pd.DataFrame:
        root = [forest.root(i) for i in range(len(ids))]
        at = [i for i, r in enumerate(root) if r != i and ids[i] != ids[r]]
        return pd.DataFrame({"a": ids[at].astype(np.int64), "b": ids[[root[i] for i in at]].astype(np.int64)})

    def alone(df: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(len(df))
        search(sets_of(df), forest, num, den)
        return edges(df["id"].to_numpy(np.int64), forest)

    def two(df: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        """Links within df and between df and other; with `known` columns, pairs in one known component are left out."""
        both = pd.concat([df, other], ignore_index=True)
        forest = Forest(len(both))
        if "known" in both:
            first: dict[int, int] = {}
            for i, k in enumerate(both["known"].tolist()):
                forest.join(first.setdefault(k, i), i)
        search(sets_of(both), forest, num, den)
        return edges(both["id"].to_numpy(np.int64), forest)

    return two if with_pivots else alone


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, group_tokens: int = GROUP_TOKENS, block_sets: int = BLOCK_SETS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id.

    Sets are those of Shingler(size); two documents link if den * intersection >= num * union, and a component's id is
    its smallest key. Null and empty texts and texts of white space have the empty set, which links with nothing. Rows
    with a null key link with nothing and have a null component. Repeated rows stay, a row each, in one component; so do rows
    of one key with different texts.

    1. Each text is named by its set; equal sets are one class, known by its smallest key. The tasks also list shingles
       that are frequent in a chunk of documents, so that all sets can be ordered by rarity alike.
    2. A set that links with another shares one of its n - need(n) + 1 rarest shingles with it. These short lists are
       grouped by shingle; in a group, sets on one list that may link by size and bit map are loosely tied; no pairs
       are shuffled. Loose components bound what must be compared, and lose no link.
    3. Texts of loose components of up to `block_sets` classes and BLOCK_TOKENS shingles meet in one task, which joins them exactly. Larger ones
       are dealt into blocks; each is joined exactly with itself and with the component's pivots. What then isn't one
       component is compared block by block: those outside the largest part with all.
    """
    t1 = _classes(docs, key, text, size)
    real = t1.where("n > 0 and id is not null")
    classes = checkpointed(real.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.first("n").alias("n")))
    total = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    sent = docs.sparkSession.sparkContext.broadcast(_order(t1))
    parts = max(LEAST_GROUPS, -(-int(total) // group_tokens))
    lists = _short_lists(docs, key, text, size, parts, sent, num, den)
    loose = checkpointed(lists.groupBy("part").applyInArrow(lambda group: _loose(group, num, den), "a long, b long"))
    tied = components(loose)
    members = classes.join(tied, F.col("c1") == F.col("node")).select("id", "n", "c1", "c2", F.col("component").alias("comp"))
    blocks = F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / BLOCK_TOKENS)).cast("long")
    sizes = members.groupBy("comp").agg(blocks.alias("m"))
    members = checkpointed(members.join(sizes, "comp").select("id", "c1", "c2", "comp", "m", F.pmod(F.xxhash64("id"), F.col("m")).alias("block")))
    small = F.col("m") <= 1
    body = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    got = checkpointed(_with_texts(members, body, size))
    links = [got.where(small).groupBy("comp").applyInPandas(_join_block(size, False, num, den), "a long, b long")]
    if not members.where(~small).isEmpty():
        links.append(_large(got.where(~small), size, num, den))
    real_links = checkpointed(union_all(links))
    found = components(real_links)
    of_class = classes.join(found, F.col("id") == F.col("node"), "left").select("c1", "c2", F.coalesce("component", "id").alias("component"))
    rows = t1.where("n >= 0").select("id", "n", "c1", "c2")
    linked_rows = rows.where("n > 0 and id is not null").join(of_class, ["c1", "c2"], "left").select("id", "n", "component")
    rest = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return linked_rows.unionByName(rest).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _with_texts(members: DataFrame, body: DataFrame, size: int) -> DataFrame:
    """Members with a text of their class. Texts are joined by key; where a key is repeated with other texts, the one
    whose set has the class's name is taken. Few members are broadcast, so that no other texts are shuffled."""
    both = body.join(F.broadcast(members) if members.count() <= MOST_BROADCAST else members, "id")

    def run(batches):
        shingler = Shingler(size)
        for batch in slices(batches):
            keep = []
            for s, a, b in zip(shingler.sets_of(raw(batch.column(1))), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                keep.append(int.from_bytes(name[:8], "little", signed=True) == a and int.from_bytes(name[8:], "little", signed=True) == b)
            yield batch.select(["id", "t", "comp", "m", "block", "c1"]).filter(pa.array(keep, pa.bool_()))

    return both.select("id", "t", "comp", "m", "block", "c1", "c2").mapInArrow(run, "id long, t string, comp long, m long, block long, c1 long").dropDuplicates(["id", "c1"])


def _large(got: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links of loose components that are too large for one task."""
    two, edge = _join_block(size, True, num, den), "a long, b long"
    last = got.groupBy("comp").agg(F.max("block").alias("last"))
    pivots = got.groupBy("comp", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PIVOTS)).alias("p")).agg(F.min_by(F.struct("id", "t"), F.xxhash64("id", F.lit(2))).alias("x"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block")
    pivots = pivots.join(last, "comp").select("comp", F.col("x.id").alias("id"), F.col("x.t").alias("t"), every)
    pivots = pivots.toDF(*pivots.columns)  # columns of its own beside got's
    near = checkpointed(got.select("comp", "block", "id", "t").groupBy("comp", "block").cogroup(pivots.groupBy("comp", "block")).applyInPandas(lambda a, b: two(a[["id", "t"]], b[["id", "t"]]), edge))
    now = components(near)
    state = checkpointed(got.select("id", "comp", "block").join(now, F.col("id") == F.col("node"), "left").select("id", "comp", "block", F.coalesce("component", "id").alias("known")))
    held = state.groupBy("comp", "known").agg(F.count("*").alias("k"))
    main = held.groupBy("comp").agg(F.max_by("known", F.struct("k", "known")).alias("main"), F.count("*").alias("pieces"), F.ceil((F.sum("k") - F.max("k")) / BLOCK_SETS).alias("asks"))
    open_ = main.where("pieces > 1")
    if open_.isEmpty():
        return near
    all_ = got.select("id", "t", "comp", "block").join(state.select("id", "known"), "id").join(open_, "comp")
    apart = all_.where("known <> main").join(last, "comp")
    asked = apart.select("comp", "id", "t", "known", F.pmod(F.xxhash64("id", F.lit(3)), F.col("asks")).alias("ask"), every)
    asked = asked.toDF(*asked.columns)
    asks = asked.select("comp", "block", "ask").distinct()
    hosts = all_.select("comp", "block", "id", "t", "known").join(asks, ["comp", "block"])
    hosts = hosts.toDF(*hosts.columns)
    rest = hosts.groupBy("comp", "block", "ask").cogroup(asked.groupBy("comp", "block", "ask")).applyInPandas(lambda a, b: two(a[["id", "t", "known"]], b[["id", "t", "known"]]), edge)
    return near.unionByName(rest)
