"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax on top."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw, slices

BUCKETS = 1 << 17
DIM = 8
GRAMS = (2, 3, 4)
#: Labelled rows that the classifier is fitted on at most: those with the smallest hash of their key.
MOST_TRAINING_ROWS = 4000
#: Bucket counts of these rows at most, in the same order: 8 bytes each in the task that fits, so 128 MB.
MOST_TRAINING_COUNTS = 16 << 20
EPOCHS, BATCH, RATE = 10, 32, 6.0
THRESHOLD = 0.7
#: Words whose scores a worker remembers.
MOST_WORDS = 400_000


def words_of(text: bytes) -> list[bytes]:
    """Words part at ASCII white space; a word that repeats the one before it is read as a mark."""
    words = text.split()
    return [b"\x04" if a == b else b for a, b in zip([None, *words], words)]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, and how many each word has: the word, and the n-grams of it between marks."""
    marked = b"".join(b"\x02" + w + b"\x03" for w in words)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(end[-1] if len(end) else 0)  # bytes up to the word's end
    b = np.frombuffer(marked, np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    out = [np.array([zlib.crc32(w) % BUCKETS for w in words], np.int64)]
    who = [np.arange(len(words))]
    h = b
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            if n > 1:
                h = h[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :]
            if n in GRAMS:
                fits = left[: len(h)] >= n
                x = h[fits] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
                out.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47)).astype(np.int64) % BUCKETS)
                who.append(owner[: len(h)][fits])
    out, who = np.concatenate(out), np.concatenate(who)
    by = np.argsort(who, kind="stable")
    return out[by], np.bincount(who, minlength=len(words))


@dataclass
class Model:
    """What scoring needs: a bucket's vector enters the score only through its product with the softmax's weights."""

    weight: np.ndarray
    bias: float


def train(buckets: np.ndarray, counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> Model:
    """Stochastic gradient descent on vectors and softmax. Documents lie one after the other: `sizes` says how many
    buckets each has, `counts` how often it has each. Without documents all score 0.5."""
    rng = np.random.default_rng(seed)
    used = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    number = np.zeros(BUCKETS, np.int32)
    number[used] = np.arange(len(used))
    where = number[buckets]
    vec = rng.uniform(-1 / dim, 1 / dim, (len(used), dim)).astype(np.float32)
    out = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    n = len(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    total = np.maximum(1, np.bincount(np.repeat(np.arange(n), sizes), counts, n)) if n else np.zeros(0)
    share = (counts / np.repeat(total, sizes)).astype(np.float32)
    steps, step = max(1, epochs * -(-n // batch)), 0
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            lr = rate * (1 - step / steps)
            step += 1
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
            size = starts[pick + 1] - starts[pick]
            owner = np.repeat(np.arange(len(pick)), size)
            f, s = where[rows], share[rows]
            contrib = vec[f] * s[:, None]
            mean = np.stack([np.bincount(owner, contrib[:, d], len(pick)) for d in range(vec.shape[1])], 1).astype(np.float32)
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            g = p / len(pick)
            back = g @ out.T
            out -= lr * 0.1 * mean.T @ g
            bias -= lr * 0.1 * g.sum(0)
            # each document moves its own features; a mean's features get that share of the step
            change = back[owner] * s[:, None] * (lr * len(pick))
            for d in range(vec.shape[1]):
                vec[:, d] -= np.bincount(f, change[:, d], len(used)).astype(np.float32)
    weight = np.zeros(BUCKETS)
    weight[used] = vec.astype(np.float64) @ (out[:, 1] - out[:, 0]).astype(np.float64)
    return Model(weight, float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def scores(self, batch: list[bytes]) -> list[float]:
        """Probability of the label 1 of each text. A text without words has the bias alone."""
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        split = [words_of(x) for x in batch]
        new = list(set().union(*split).difference(known)) if split else []
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            f, n = features(part)
            total = np.add.reduceat(self.model.weight[f], np.concatenate([[0], np.cumsum(n)[:-1]]))
            known.update(zip(part, zip(total.tolist(), n.tolist())))
        out = []
        for words in split:
            pairs = [known[w] for w in words]
            n = sum(p[1] for p in pairs)
            z = self.model.bias + (sum(p[0] for p in pairs) / n if n else 0.0)
            out.append(float(np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 6)))
        return out


def held_out(key: str = "doc_id"):
    """Rows whose crc32 of the key as text leaves 2 on division by 4; never true for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_TRAINING_ROWS, most_counts: int = MOST_TRAINING_COUNTS) -> Model:
    """Fits on at most `most_rows` labelled documents that aren't held out, chosen by a hash of their keys; of these, in
    the same order, on as many as have `most_counts` bucket counts together.

    Null keys, labels other than 0 and 1 and labels without a document are left out; of repeated labels the largest
    counts, of repeated documents the smallest text (null as empty). Repeated rows become one before features are made,
    a long text at most BUCKETS counts; then one task, which gets the bounded sample in order, runs the descent. The
    driver gets the model, a megabyte. Without a sample all scores are 0.5.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull())
    known = known.where(~held_out("k")).groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most_rows)
    sample = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(known), "k").groupBy("k", "y").agg(F.min("t").alias("t"))

    def run(batches):
        for batch in slices(batches, 64):
            out = []
            for x in raw(batch.column(2)):
                words = words_of(x)
                f, c = np.unique(features(words)[0], return_counts=True) if words else (np.zeros(0, np.int64),) * 2
                out.append((f.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["h", "y", "f", "c"])

    def descend(batches):
        parts, y, room = ([], []), [], most_counts
        for batch in batches:
            for f, c, label in zip(batch.column(2), batch.column(3), batch.column(1).to_pylist()):
                room -= f.as_buffer().size // 4
                if room < 0:
                    break
                for own, x in zip(parts, (f, c)):
                    own.append(np.frombuffer(x.as_py(), np.int32))
                y.append(label)
            if room < 0:
                break
        sizes = np.array([len(f) for f in parts[0]], np.int64)
        buckets, counts = (np.concatenate([np.zeros(0, np.int32), *x]) for x in parts)
        model = train(buckets, counts, sizes, np.array(y, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])

    made = sample.select(F.struct(F.xxhash64("k").alias("h"), "k").alias("h"), "y", "t")
    made = made.mapInArrow(run, T.StructType([made.schema["h"], *T._parse_datatype_string("y int, f binary, c binary").fields]))
    got = made.repartition(1).sortWithinPartitions("h").mapInArrow(descend, "weight binary, bias double").first()
    return Model(np.frombuffer(bytes(got.weight), np.float64), got.bias) if got else train(*(np.zeros(0, np.int64),) * 4)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, carry: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Per row of docs: key (all columns with carry=True, but those with the new names), score, predicted.

    Whole texts are scored; null and empty ones too. Repeated rows get equal scores. No shuffle; a worker remembers the
    scores of a bounded number of words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*[c for c in docs.columns if c not in names]) if carry else docs.select(key, text)
    own = plain.columns
    at, kept = own.index(text), own if carry else [key]

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            s = scorer.scores(raw(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*[batch.column(own.index(c)) for c in kept], pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*kept, *names])

    return plain.mapInArrow(run, T.StructType([*[plain.schema[c] for c in kept], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))
