"""Ranked lexical search as exact inner-product search in sparse ball trees of the documents' term vectors."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, from_lists, raw, slices, union_all
from .decontaminate import words

#: Documents of one tree at most, its terms at most, and documents of a leaf.
TREE_DOCS, TREE_TERMS, LEAF_DOCS = 4096, 2_000_000, 32
#: Words of questions that are looked for in one pass over the documents; this bounds what is broadcast.
BLOCK_WORDS = 250_000
#: Documents returned for a question.
TOP = 10
#: What a bound is raised by, relative to the largest number in it; sums in doubles are exact to 1e-11 or better.
SLACK = 1e-9


def gather(ptr: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the given rows' elements in a table of rows that begin at ptr, and where each row begins among them."""
    n = ptr[which + 1] - ptr[which]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(ptr[which] - ends + n, n), ends - n


class BallTree:
    """Sparse vectors with components of 0 or more, split at the median between two far ones until a leaf is small.

    ptr, ids, values: rows of whole numbers, none empty. A node has the mean of its vectors and the largest distance
    from it, raised for rounding. Nodes' means lie by column, so that a question reads those of its terms only.
    """

    def __init__(self, ptr: np.ndarray, ids: np.ndarray, values: np.ndarray, leaf: int = LEAF_DOCS):
        self.terms, cols = np.unique(ids, return_inverse=True)
        width, exact = len(self.terms), values.astype(np.float64)
        norm = np.add.reduceat(exact * exact, ptr[:-1])
        order, self.nodes, self.radius, means = np.arange(len(ptr) - 1), [], [], []

        def dots(at: np.ndarray, starts: np.ndarray, dense: np.ndarray) -> np.ndarray:
            return np.add.reduceat(exact[at] * dense[cols[at]], starts)

        def one(i: int) -> np.ndarray:
            dense = np.zeros(width)
            dense[cols[ptr[i] : ptr[i + 1]]] = exact[ptr[i] : ptr[i + 1]]
            return dense

        todo = [(0, len(order), -1)]
        while todo:
            a, b, up = todo.pop()
            own = order[a:b]
            at, starts = gather(ptr, own)
            mean = np.bincount(cols[at], exact[at], width) / (b - a)
            size = mean @ mean
            apart = np.maximum(norm[own] - 2 * dots(at, starts, mean) + size, 0)
            self.radius.append(math.sqrt(apart.max() + SLACK * (norm[own].max() + size)))
            found = np.flatnonzero(mean)
            means.append((found, mean[found]))
            if up >= 0:
                self.nodes[up][2].append(len(self.nodes))
            self.nodes.append((a, b, []))
            if b - a > leaf:
                far = own[np.argmax(apart)]
                other = own[np.argmax(norm[own] - 2 * dots(at, starts, one(far)))]
                side = np.argsort(dots(at, starts, one(other)) - dots(at, starts, one(far)), kind="stable")
                order[a:b] = own[side]
                half = (a + b) // 2
                todo += [(half, b, len(self.nodes) - 1), (a, half, len(self.nodes) - 1)]
        self.order = order
        at, starts = gather(ptr, order)
        self.ptr, self.cols, self.values = np.append(starts, len(at)), cols[at], values[at]
        self.radius = np.array(self.radius)
        column = np.concatenate([x for x, _ in means])
        by = np.argsort(column, kind="stable")
        self.mean_ptr = np.searchsorted(column[by], np.arange(width + 1))
        self.mean_node = np.repeat(np.arange(len(means)), [len(x) for x, _ in means])[by]
        self.mean = np.concatenate([x for _, x in means])[by]

    def bounds(self, cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No vector of a node has a larger product: that with its mean, and Cauchy-Schwarz for what is left, which has
        components where the mean has some only."""
        at, _ = gather(self.mean_ptr, cols)
        w = np.repeat(weights.astype(np.float64), self.mean_ptr[cols + 1] - self.mean_ptr[cols])
        node, n = self.mean_node[at], len(self.radius)
        dot, square = np.bincount(node, w * self.mean[at], n), np.bincount(node, w * w, n)
        return (dot + np.sqrt(square) * self.radius) * (1 + SLACK) + SLACK

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, found):
        """Calls found(rows, scores) with the scores of a leaf's rows, leaves with the largest bound first; found returns
        the new least score of interest. Ends when no node's bound reaches it. Returns the number of leaves read."""
        cols = np.searchsorted(self.terms, terms)
        here = (cols < len(self.terms)) & (self.terms[np.minimum(cols, len(self.terms) - 1)] == terms)
        cols, weights = cols[here], weights[here]
        if not len(cols):
            return 0
        bound, dense, leaves = self.bounds(cols, weights).tolist(), np.zeros(len(self.terms), np.int64), 0
        dense[cols] = weights
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            a, b, below = self.nodes[heapq.heappop(heap)[1]]
            if below:
                for x in below:
                    if bound[x] >= least:
                        heapq.heappush(heap, (-bound[x], x))
                continue
            leaves += 1
            lo, hi = self.ptr[a], self.ptr[b]
            scores = np.add.reduceat(self.values[lo:hi] * dense[self.cols[lo:hi]], self.ptr[a:b] - lo)
            least = found(self.order[a:b], scores)
        return leaves


class Best:
    """The `top` rows with the largest scores above 0; equal scores by ascending key, nulls last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def least(self) -> int:
        """A score below this is of no use."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, keys: list, scores: np.ndarray, rows: np.ndarray) -> int:
        fine = np.flatnonzero(scores >= self.least())
        if len(fine):
            new = [(-int(s), keys[r] is None, keys[r]) for s, r in zip(scores[fine], rows[fine].tolist())]
            self.rows = heapq.nsmallest(self.top, self.rows + new, key=lambda x: x if not x[1] else x[:2])
        return self.least()


class Trees:
    """Gathers a task's documents into trees of bounded size, and searches each for all questions when it is full."""

    def __init__(self, questions: list[tuple[np.ndarray, np.ndarray]], top: int, docs: int = TREE_DOCS, terms: int = TREE_TERMS):
        self.questions, self.best = questions, [Best(top) for _ in questions]
        self.docs, self.most, self.leaves, self.all_leaves = docs, terms, 0, 0
        self.keys, self.ids, self.values, self.n = [], [], [], 0

    def add(self, key, ids: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(key)
        self.ids.append(ids)
        self.values.append(values)
        self.n += len(ids)
        if len(self.keys) >= self.docs or self.n >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.keys:
            ptr = np.cumsum([0, *map(len, self.ids)])
            tree = BallTree(ptr, np.concatenate(self.ids), np.concatenate(self.values))
            for best, (terms, weights) in zip(self.best, self.questions):
                self.leaves += tree.search(terms, weights, best.least(), lambda rows, scores, b=best: b.add(self.keys, scores, rows))
                self.all_leaves += sum(not x[2] for x in tree.nodes)
            self.keys, self.ids, self.values, self.n = [], [], [], 0


def _questions(items: DataFrame, block_words: int):
    """Blocks of (item number, its terms once each), of a bounded number of words; the driver holds one block."""
    block, size = [], 0
    for row in items.select("no", "item_text").toLocalIterator():
        terms = sorted(set(words((row.item_text or "").encode())))
        if not terms:
            continue
        if block and size + len(terms) > block_words:
            yield block
            block, size = [], 0
        block.append((row.no, terms))
        size += len(terms)
    if block:
        yield block


def _vectors(plain: DataFrame, vocabulary) -> DataFrame:
    """Per document: key, n (its terms with repeats), and number and occurrences of each of the questions' terms."""

    def run(batches):
        known = vocabulary.value
        for batch in slices(batches):
            n, ids, times = [], [], []
            for x in raw(batch.column(1)):
                seq = words(x)
                has = Counter(map(known.get, seq))
                has.pop(None, None)
                n.append(len(seq))
                ids.append(np.fromiter(has.keys(), np.int64, len(has)))
                times.append(np.fromiter(has.values(), np.int64, len(has)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), from_lists(ids, pa.int32()), from_lists(times, pa.int32())], names=["id", "n", "ids", "times"])

    kinds = plain.select("id", F.lit(0).cast("long").alias("n"), F.array(F.lit(0)).alias("ids"), F.array(F.lit(0)).alias("times")).schema
    return plain.mapInArrow(run, kinds)


def _ranked(plain: DataFrame, block: list, top: int) -> DataFrame:
    """The best documents of each task for each question of a block: no, id, score."""
    sc = plain.sparkSession.sparkContext
    numbers = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    docs = checkpointed(_vectors(plain, sc.broadcast(numbers)))
    count, length = docs.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(numbers), np.int64)
    for term, n in docs.select(F.explode("ids").alias("t")).groupBy("t").count().toLocalIterator():
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    asked = sc.broadcast([(no, ids := np.array([numbers[t] for t in terms], np.int64), weight[ids]) for no, terms in block])
    kinds = plain.select(F.lit(0).cast("long").alias("no"), "id", F.lit(0).cast("long").alias("score")).schema

    def run(batches):
        numbers, terms, weights = zip(*asked.value)
        trees, kind = Trees(list(zip(terms, weights)), top), None
        for batch in slices(batches, 4096):
            kind = batch.column(0).type
            keys, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ptr, ids, times = (batch.column(2).offsets.to_numpy(), *(batch.column(i).flatten().to_numpy() for i in (2, 3)))
            ptr = ptr - ptr[0]
            for i in range(batch.num_rows):
                if ptr[i] < ptr[i + 1]:
                    tf = times[ptr[i] : ptr[i + 1]].astype(np.int64)
                    m = 10 + 90 * n[i] * count // length
                    trees.add(keys[i], ids[ptr[i] : ptr[i + 1]].astype(np.int64), 1_000_000_000 * tf // (1000 * tf + 8 * m))
        trees.flush()
        for no, best in zip(numbers, trees.best):
            if best.rows:
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(best.rows), pa.int64()), pa.array([x[2] for x in best.rows], kind), pa.array([-x[0] for x in best.rows], pa.int64())], names=["no", "id", "score"])

    return docs.mapInArrow(run, kinds)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per item its `top` documents with the highest scores above 0: item key, rank (from 1), document key, score.

    Terms are runs of digits, letters and characters outside ASCII, A-Z in lower case. With N documents that have a
    term, L terms in them, n in one document, df documents with a term and tf of it in the document, a term weighs
    floor(1000 ln((2N+2)/(2df+1))) and a document scores the sum, over the item's terms once each, of weight times
    (10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L, in whole numbers. Equal scores go by ascending document key,
    nulls last. Null and empty texts have no terms: such documents are in no list, such items have no rows. Rows that
    are repeated count as documents, and as items, of their own; tables without rows give no rows; other columns aren't
    read, so that none can clash. Long texts are counted whole.

    A document is a vector over the questions' terms. Each task puts the documents that it reads into ball trees of at
    most TREE_DOCS and searches each best-first for all questions, with the scores that its earlier trees gave as the
    least of interest: a subtree is left out if no vector in it can reach that score. So documents aren't shuffled, a
    task gives `top` rows a question, and no group of equal documents meets in one task. The driver and each worker hold
    one block of questions, `block_words` words or one question; each block makes a pass over the documents.
    """
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    asked = checkpointed(items.select(F.monotonically_increasing_id().alias("no"), F.col(item_key).alias("item"), F.col(item_text).alias("item_text")))
    found = [_ranked(plain, block, top) for block in _questions(asked, block_words)]
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    none = plain.where("false").select(F.lit(0).cast("long").alias("no"), "id", F.lit(0).cast("long").alias("score"))
    ranked = union_all(found or [none]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("no", "item"), "no").select(F.col("item").alias(item_key), "rank", F.col("id").alias(key), "score")
