"""Substring dedup: runs of consecutive sentences are hashed, joined over all documents, and later copies cut out."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts

#: Words that a run must have. A run is the fewest sentences that reach it, from a sentence on or up to one.
LEAST_WORDS = 20
#: Runs that a task compares with each other before it sends them on.
CHUNK_RUNS = 400_000
_END = re.compile(r"[.!?]+(?=\s)|\n")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, without outer white space. Line ends part sentences, as do . ! ? before white space."""
    out, last = [], 0
    for m in [*[m.end() for m in _END.finditer(text)], len(text)]:
        part = text[last:m]
        body = part.strip()
        if body:
            a = last + len(part) - len(part.lstrip())
            out.append((a, a + len(body)))
        last = m
    return out


def runs(text: str, least_words: int = LEAST_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, hash) of each run: a sentence starts at most one and ends at most one.

    Sentences count as equal if their words are, in lower case. A sentence of `least_words` words is a run by itself.
    """
    size, digest = [], []
    for a, b in sentences(text):
        w = text[a:b].lower().split()
        size.append(len(w))
        digest.append(hashlib.blake2b(" ".join(w).encode(), digest_size=12).digest())
    found, n = set(), len(size)
    j = total = 0
    for i in range(n):
        while j < n and total < least_words:
            total += size[j]
            j += 1
        if total >= least_words:
            found.add((i, j))
        total -= size[i]
    i, total = n, 0
    for j in range(n, 0, -1):
        while i > 0 and total < least_words:
            i -= 1
            total += size[i]
        if total >= least_words:
            found.add((i, j))
        total -= size[j - 1]
    return [(i, j, digest[i] if j == i + 1 else hashlib.blake2b(b"".join(digest[i:j]), digest_size=12).digest()) for i, j in sorted(found)]


def _less(a: tuple, b: tuple) -> bool:
    """Order of (key, text hash, sentence), null keys first."""
    return (a[0] is not None, a[0] or 0, *a[1:]) < (b[0] is not None, b[0] or 0, *b[1:])


def _sent_on(batches, least_words: int):
    """Runs as rows (id, th, i, j, h, g, late). Within a chunk only the first of equal runs goes on to be compared with
    other tasks' runs; the others are late for certain."""
    first: dict[bytes, tuple] = {}
    out: list[tuple] = []

    def rows(parts: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in parts], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()))], names=["id", "th", "i", "j", "h", "g", "late"])

    def row(x: tuple, name: bytes, late: bool) -> tuple:
        return *x, int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True), late

    for batch in slices(batches):
        for k, th, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            for i, j, name in runs(x, least_words):
                new, old = (k, th, i, j), first.get(name)
                if old is None:
                    first[name] = new
                elif _less(new[:3], old[:3]):
                    first[name] = new
                    out.append(row(old, name, True))
                elif new[:3] != old[:3]:
                    out.append(row(new, name, True))
        if len(first) >= CHUNK_RUNS:
            out += [row(v, name, False) for name, v in first.items()]
            first.clear()
        if len(out) >= 20_000:
            yield rows(out)
            out = []
    out += [row(v, name, False) for name, v in first.items()]
    for at in range(0, len(out), 50_000):
        yield rows(out[at : at + 50_000])


def late_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, th, i, j): runs of sentences that an earlier place has too. th is a hash of the text, so that documents with
    one key and different texts stay apart."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    found = plain.mapInArrow(lambda b: _sent_on(b, least_words), "id long, th long, i int, j int, h long, g int, late boolean")
    # a late run needs no comparison: it is dealt by its own place, so that copies of a hot run spread out
    alone = F.when(F.col("late"), F.xxhash64("id", "th", "i")).otherwise(F.lit(0))
    rank = F.dense_rank().over(Window.partitionBy("h", "g", "late", alone).orderBy("id", "th", "i"))
    return found.withColumn("r", rank).where("late or r > 1").select("id", "th", "i", "j")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with sentences cut out of the text that lie in a run which an earlier place has too, and more columns:
    n_sentences, n_removed (sentences), removed (array of start and end of what was cut, code points of the old text).

    Earlier means a smaller key (null first), then a smaller hash of the text, then an earlier sentence; so the first
    copy stays in place and copies within a document go, too. Rows equal in key and text are one document: they are
    cut alike and don't count as copies of each other. Null and empty texts stay as they are. What is cut goes with
    the white space after it. Columns of docs named like the new ones are replaced.

    Equal runs are first compared within the tasks that read them, so that a run in a third of all documents sends a row
    from each task's chunk; the rest is dealt by hash. Cut places are then joined to the texts by key.
    """
    new = ["n_sentences", "n_removed", "removed"]
    kept = docs.drop(*new)
    late = late_runs(kept, key, text, least_words).groupBy("id", "th").agg(F.collect_set(F.struct("i", "j")).alias("_cut"))
    base = kept.withColumns({"_id": F.col(key).cast("long"), "_th": F.xxhash64(text)})
    both = base.join(late, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left").select(*[base[c] for c in kept.columns], "_cut")
    names = kept.columns
    at = names.index(text)

    def run(batches):
        for batch in slices(batches):
            out, n, gone, spans = [], [], [], []
            for x, cut in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                where = sentences(x or "")
                drop = sorted({s for c in cut or [] for s in range(c["i"], c["j"])})
                merged: list[list[int]] = []
                for s in drop:
                    a, b = where[s][0], where[s + 1][0] if s + 1 < len(where) else len(x)
                    if merged and merged[-1][1] == a:
                        merged[-1][1] = b
                    else:
                        merged.append([a, b])
                if merged:
                    parts, last = [], 0
                    for a, b in merged:
                        parts.append(x[last:a])
                        last = b
                    x = "".join([*parts, x[last:]])
                out.append(x)
                n.append(len(where))
                gone.append(len(drop))
                spans.append([y for m in merged for y in m])
            yield pa.RecordBatch.from_arrays([*[pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))], pa.array(n, pa.int32()), pa.array(gone, pa.int32()), pa.array(spans, pa.list_(pa.int32()))], names=[*names, *new])

    return both.mapInArrow(run, T.StructType([*kept.schema.fields, *T._parse_datatype_string("n_sentences int, n_removed int, removed array<int>").fields]))
