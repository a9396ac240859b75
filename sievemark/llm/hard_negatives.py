"""Hard negatives by rotated one-bit codes: intervals that surely hold a score filter rows, survivors are scored whole."""

from __future__ import annotations

import math
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, get_arrays, new_folder, put_arrays

#: Rows of a stripe and anchors of a block, about; a task compares one block with one stripe at a time.
STRIPE_ROWS, BLOCK_ANCHORS = 8192, 512
#: Tasks at most; where there are more pairs of a block and a stripe, a task takes several, one after the other.
MOST_TASKS = 100_000
#: Positives of an anchor, negatives of a positive, and the least share of the positive's score, as a fraction.
POSITIVES, NEGATIVES, SHARE = 5, 5, (80, 100)
#: A component becomes a whole number of so many parts of 1.
SCALE = 256
#: Bits of a component of the rotated anchor; its rounding is part of the interval.
PLANES = 6
#: Means of a stripe: one for so many rows, so many at most, and how often they are moved.
CENTRE_ROWS, MOST_CENTRES, CENTRE_ROUNDS = 128, 64, 4
#: Rows that are scored first, those with the highest intervals.
CHUNK = 64
#: What intervals are widened by, relative to the product of lengths; doubles are exact to 1e-12 here.
SLACK = 1e-9


@lru_cache(4)
def rotation(d: int) -> np.ndarray:
    """A fixed orthogonal matrix; any would give right intervals, this one spreads lengths over components."""
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    some = np.packbits(bits, axis=-1, bitorder="little")
    return np.concatenate([some, np.zeros((*some.shape[:-1], -some.shape[-1] % 8), np.uint8)], -1).view(np.uint64)


def _centres(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few means and each row's nearest. They only make codes' lengths shorter, so that any would be right."""
    k = int(np.clip(len(x) // CENTRE_ROWS, 1, MOST_CENTRES))
    means = x[np.random.default_rng(k).permutation(len(x))[:k]]
    for _ in range(CENTRE_ROUNDS):
        near = np.argmin((means * means).sum(1) - 2 * x @ means.T, 1)
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        means = np.where(n > 0, sums / np.maximum(n, 1), means)
    return means, np.argmin((means * means).sum(1) - 2 * x @ means.T, 1)


def encode(whole: np.ndarray) -> dict[str, np.ndarray]:
    """Codes of rows of whole numbers. A row is one of a few means and a rest; of the rest there are its length, the
    one-bit code of its rotated direction, and the alignment, the direction's product with its own code vector
    (+-1/sqrt(d) by component). A rest of zeros has length 0."""
    means, near = _centres(whole.astype(np.float64))
    x = whole - means[near]
    size = np.sqrt((x * x).sum(1))
    unit = x / np.where(size > 0, size, 1)[:, None] @ rotation(x.shape[1]).T
    return {"means": means, "near": near, "size": size, "code": _packed(unit >= 0), "aligned": np.abs(unit).sum(1) / math.sqrt(x.shape[1])}


class Anchors:
    """Rotated anchors in bit planes, to be held against codes by counting bits."""

    def __init__(self, whole: np.ndarray):
        self.whole = x = whole.astype(np.float64)
        self.d = x.shape[1]
        self.size = np.sqrt((x * x).sum(1))
        unit = x / np.where(self.size > 0, self.size, 1)[:, None] @ rotation(self.d).T
        self.low = unit.min(1, initial=0)
        self.step = np.maximum((unit.max(1, initial=0) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.clip(np.rint((unit - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1).astype(np.int64)
        self.planes = [_packed((level >> p & 1).astype(bool)) for p in range(PLANES)]
        rounded = self.low[:, None] + self.step[:, None] * level
        self.total = rounded.sum(1)
        # |<code vector, unit - rounded>| is at most the length of the rounding
        self.off = np.sqrt(((unit - rounded) ** 2).sum(1)) + SLACK

    def interval(self, i: int, codes: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product that anchor i can have with each of the rows `at`.

        The product with a row's mean is known. The rest's direction is its alignment times its code vector and what is
        at right angles to that, of length sqrt(1 - aligned^2); by Cauchy-Schwarz this gives at most its length times
        that of the anchor's own part at right angles to the code vector. The anchor's product with the code vector, s,
        is known but for its rounding.
        """
        code, aligned, size, near = (codes[k][at] for k in ("code", "aligned", "size", "near"))
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        both = sum(np.bitwise_count(code & plane[i]).sum(1, dtype=np.int64) << p for p, plane in enumerate(self.planes))
        s = (2 * (self.low[i] * ones + self.step[i] * both) - self.total[i]) / math.sqrt(self.d)
        rest = np.sqrt(np.maximum(1 - aligned * aligned, 0))
        nearest = np.maximum(np.abs(s) - self.off[i], 0)
        around = aligned * self.off[i] + rest * np.sqrt(np.maximum(1 - nearest * nearest, 0))
        means = codes["means"]
        middle = (means @ self.whole[i])[near] + aligned * s * self.size[i] * size
        slack = SLACK * self.size[i] * (size + np.sqrt((means * means).sum(1))[near])
        around = around * self.size[i] * size + slack
        return middle - around, middle + around


def products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact whole-number products; an error where one might not fit into 64 bits."""
    if len(rows) and float(np.abs(rows).max()) * float(np.abs(anchor).max()) * rows.shape[1] >= 2.0**62:
        exact = [sum(a * b for a, b in zip(x, anchor.tolist())) for x in rows.tolist()]
        if max(map(abs, exact)) >= 1 << 63:
            raise ValueError("a score does not fit into 64 bits")
        return np.array(exact, np.int64)
    return rows @ anchor


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, equal ones by ascending id."""
    return np.lexsort((ids, -scores))[:k]


def _kth(x: np.ndarray, k: int) -> float:
    """The k-th largest, or less than any number where there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


class Stripe:
    """A stripe's rows: ids, labels, whole numbers and codes."""

    def __init__(self, **arrays: np.ndarray):
        self.ids, self.label, self.whole, self.codes = arrays["ids"], arrays["label"], arrays["whole"], arrays

    def best(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, k: int, least: float, most: float, known: "Known") -> list[tuple[int, int]]:
        """(row, score) of the first k of the rows `at` whose scores are from least to most.

        low, high: their intervals. Rows are scored whole, those with the highest intervals first, in chunks that double,
        while one that is left could still be among the first. known: scores of rows scored before; gets the new ones.
        """
        within = np.flatnonzero((high >= least) & (low <= most))
        sure = _kth(low[within][(low[within] >= least) & (high[within] <= most)], k)
        within = within[high[within] >= sure]
        within = within[np.argsort(-high[within], kind="stable")]
        rows, scores, start, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, CHUNK
        while start < len(within) and (len(rows) < k or high[within[start]] >= scores[-1]):
            some = within[start : start + step]
            new = known.scores(self.whole, at, some, anchor)
            fine = (new >= least) & (new <= most)
            rows, scores = np.concatenate([rows, at[some[fine]]]), np.concatenate([scores, new[fine]])
            top = first(scores, self.ids[rows], k)
            rows, scores, start, step = rows[top], scores[top], start + step, 2 * step
        return list(zip(rows.tolist(), scores.tolist()))


class Known:
    """Whole scores of one anchor with some rows, each computed once."""

    def __init__(self, n: int):
        self.have, self.value = np.zeros(n, bool), np.zeros(n, np.int64)

    def __len__(self) -> int:
        return int(self.have.sum())

    def scores(self, whole: np.ndarray, at: np.ndarray, some: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        new = some[~self.have[some]]
        self.value[new], self.have[new] = products(whole[at[new]], anchor), True
        return self.value[some]


def positives(stripe: Stripe, ids: np.ndarray, label: np.ndarray, whole: np.ndarray, k: int = POSITIVES, seen: list | None = None):
    """(anchor, row, score) of a stripe's first k other rows of each anchor's label. seen: gets (rows scored, of rows)."""
    anchors = Anchors(whole)
    for i in range(len(ids)):
        at = np.flatnonzero((stripe.label == label[i]) & (stripe.ids != ids[i]))
        known = Known(len(at))
        for row, score in stripe.best(at, *anchors.interval(i, stripe.codes, at), whole[i], k, -np.inf, np.inf, known):
            yield ids[i], stripe.ids[row], score
        if seen is not None:
            seen.append((len(known), len(at)))


def negatives(stripe: Stripe, ids: np.ndarray, label: np.ndarray, whole: np.ndarray, asked: np.ndarray, k: int = NEGATIVES, share: tuple[int, int] = SHARE, seen: list | None = None):
    """(anchor, positive's score, row, score) of a stripe's first k rows of other labels within the share of each score.

    asked: rows of (anchor's place in ids, positive's score), scores above or equal to 0.
    """
    anchors = Anchors(whole)
    for i in np.unique(asked[:, 0]).tolist():
        at = np.flatnonzero(stripe.label != label[i])
        known = Known(len(at))
        low, high = anchors.interval(i, stripe.codes, at)
        for most in np.unique(asked[asked[:, 0] == i, 1]).tolist():
            for row, score in stripe.best(at, low, high, whole[i], k, -(-share[0] * most // share[1]), most, known):
                yield ids[i], most, stripe.ids[row], score
        if seen is not None:
            seen.append((len(known), len(at)))


def _longs(found, *names: str) -> pa.RecordBatch:
    rows = np.array(list(found), np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(len(names))], names=names)


def hard_negatives(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", stripe_rows: int = STRIPE_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x); a score is the whole-number inner product with the anchor. An anchor (rows where
    `anchor` is true) has as positives its first POSITIVES other rows of the same label; for each of them the first
    NEGATIVES rows of other labels with scores between 80 % and all of the positive's. Higher scores come first, equal
    ones by smaller key; fewer are returned where there are fewer. Rows with a null key, label or vector, an empty
    vector, or a null or non-finite component take no part. Rows are compared only if their vectors are of one length;
    rows with the anchor's own key are never its partners, so a key should be unique: of rows that repeat a key all take
    part, with the key as their name. Tables without rows or anchors give no rows; other columns aren't read. A score
    beyond 64 bits is an error. Long vectors only make stripes larger.

    Rows are dealt by hash into stripes, anchors into blocks, each a file in the shared folder that a checkpoint names. A
    task opens one block and its stripes in turn and yields a few rows an anchor; Spark then takes the first of all
    stripes. Labels don't deal rows, so a label that most rows have is no hot key.
    """
    wide = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    own = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(key).cast("long").alias("id"), own.cast("string").alias("label"), F.transform(wide, lambda x: F.floor(x * SCALE)).alias("whole"), F.size(vector).alias("d"), F.coalesce(anchor, F.lit(False)).alias("asks")).where(fine & own.isNotNull())
    spark, folder = vectors.sparkSession, new_folder(vectors.sparkSession, "stripes")
    sizes = rows.groupBy("d").agg(F.ceil(F.count("*") / stripe_rows).cast("int").alias("stripes"), F.greatest(F.lit(1), F.ceil(F.count_if("asks") / block_anchors)).cast("int").alias("blocks"))
    sizes = checkpointed(sizes)
    dealt = rows.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "d")

    def put(group: pd.DataFrame) -> pd.DataFrame:
        path, whole = f"{folder}/{uuid.uuid4().hex}", np.array(group["whole"].tolist(), np.int64)
        put_arrays(path, ids=group["id"].to_numpy(np.int64), label=np.array(group["label"].tolist(), np.str_), whole=whole, **encode(whole))
        return pd.DataFrame({"d": [int(group["d"].iloc[0])], "part": [int(group["part"].iloc[0])], "blocks": [int(group["blocks"].iloc[0])], "path": [path]})

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias("part")

    kept = "d int, part int, blocks int, path string"
    stripes = checkpointed(dealt.select("d", "id", "label", "whole", "blocks", part("stripes")).groupBy("d", "part").applyInPandas(put, kept))
    blocks = checkpointed(dealt.where("asks").select("d", "id", "label", "whole", "blocks", part("blocks")).groupBy("d", "part").applyInPandas(put, kept))
    # every block with every stripe of its length, by the numbers that name them; files are opened in the tasks
    pairs = stripes.select("d", F.col("path").alias("stripe"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    pairs = checkpointed(pairs.join(blocks.select("d", "part", F.col("path").alias("block")), ["d", "part"]).select("block", "stripe"))
    tasks = max(1, min(pairs.count(), MOST_TASKS))

    def find_positives(batches):
        for batch in batches:
            for block, stripe in zip(*(batch.column(c).to_pylist() for c in ("block", "stripe"))):
                z = get_arrays(block)
                yield _longs(positives(Stripe(**get_arrays(stripe)), z["ids"], z["label"], z["whole"]), "anchor_id", "positive_id", "positive_score")

    found = pairs.repartition(tasks).mapInArrow(find_positives, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = checkpointed(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= POSITIVES).drop("n"))

    # a block's anchors with what they are asked; scores below 0 have no rows between 80 % and all of them
    asked = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))
    which = dealt.where("asks").select("d", part("blocks"), F.col("id").alias("anchor_id")).distinct()
    asked = which.join(asked, "anchor_id").join(blocks.select("d", "part", F.col("path").alias("block")), ["d", "part"])

    def put_asked(group: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        put_arrays(path, asked=np.array([(a, s) for a, x in zip(group["anchor_id"], group["scores"]) for s in x], np.int64).reshape(-1, 2))
        return pd.DataFrame({"block": [group["block"].iloc[0]], "asked": [path]})

    asked = checkpointed(asked.groupBy("block").applyInPandas(put_asked, "block string, asked string"))

    def find_negatives(batches):
        for batch in batches:
            for block, stripe, what in zip(*(batch.column(c).to_pylist() for c in ("block", "stripe", "asked"))):
                z, pairs = get_arrays(block), get_arrays(what)["asked"]
                place = {x: i for i, x in enumerate(z["ids"].tolist())}
                pairs = np.array([(place[a], s) for a, s in pairs.tolist()], np.int64).reshape(-1, 2)
                yield _longs(negatives(Stripe(**get_arrays(stripe)), z["ids"], z["label"], z["whole"], pairs), "anchor_id", "positive_score", "negative_id", "negative_score")

    hard = pairs.join(asked, "block").repartition(tasks).mapInArrow(find_negatives, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return near.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
