"""Token-id files: raw ids of documents in key order, with a minimal perfect hash index beside each shard."""

from __future__ import annotations

import gc
import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import checkpointed, new_folder, slices, texts
from .mph import Index

#: Bytes of words and their ids that a worker remembers (by estimate), and how many new words it encodes at once.
MOST_CACHE_BYTES, NEW_WORDS = 96 << 20, 4096
#: Longer words seldom come again; they are encoded each time that a batch has them.
MOST_CACHED_CHARS = 10
#: What a remembered word takes beside its characters: two objects and a place in a table.
_ENTRY_BYTES = 190
#: Characters of a text that are taken apart at once.
PIECE = 1 << 20
#: Between words that are encoded as one text. Words that hold it, or may be special tokens, are encoded alone.
_MARK = "|"
_TAIL = ".,;:!?"
MOST_MODEL_BYTES = 64 << 20


class WordEncoder:
    """Ids of a text for a tokenizer that drops white space: each word's ids are the same wherever it stands.

    Words part at blank, tab, line feed and carriage return only. Ids are kept as packed integers, so that a text's
    payload is the joined bytes of its words. What is remembered is bounded in bytes: words are in a newer and an older
    half; once the newer one is full it becomes the older one, and of that what is used again moves back.
    """

    def __init__(self, model: bytes, kind: str, most_bytes: int = MOST_CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(model.decode())
        self.kind, self.most = kind, most_bytes // 2
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        suffix = json.loads(model).get("model", {}).get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        if suffix:
            self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True

    def _cut(self, words: list[str], mark: bool) -> dict[str, bytes]:
        """Packed ids of words encoded as one text: cut at the marks between them, or, where each word is one piece,
        after the ids that end a piece. Nothing if that doesn't give as many parts as there are words."""
        text = (f" {_MARK} " if mark else " ").join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        width, data = ids.itemsize, ids.tobytes()
        if mark:
            at = np.flatnonzero(ids == self.mark)
            begin, end = np.concatenate([[0], at + 1]), np.concatenate([at, [len(ids)]])
        else:
            end = np.flatnonzero(self.last[ids]) + 1
            begin = np.concatenate([[0], end[:-1]])
        if len(end) != len(words):
            return {}
        return {w: data[a:b] for w, a, b in zip(words, (begin * width).tolist(), (end * width).tolist())}

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word: those of letters alone together, the others with marks between, odd ones alone."""
        alpha = [w for w in words if w.isalpha() and "İ" not in w]
        done = self._cut(alpha, False) if alpha else {}
        plain = [w for w in words if w not in done and _MARK not in w and "<" not in w] if self.mark is not None else []
        if plain:
            done.update(self._cut(plain, True))
        rest = [w for w in words if w not in done]
        done.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        return done

    @staticmethod
    def parts(word: str) -> tuple[str, str]:
        """A word as what stands before its last marks, and these: after an ASCII letter or digit, or a lower-case letter
        of others, marks are always a piece of their own. ASCII words are taken in lower case, as the tokenizer does,
        unless they may be special tokens."""
        core = word.rstrip(_TAIL)
        if word.isascii():
            if "<" in word:
                return word, ""
            return (core.lower(), word[len(core) :]) if core and core[-1].isalnum() else (word, "")
        return (core, word[len(core) :]) if core and core[-1].islower() and core[-1].isalpha() else (word, "")

    def _learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of words that the newer half lacks. They and their cores are put there, unless they are long."""
        found: dict[str, bytes] = {}
        split: dict[str, tuple[str, str]] = {}
        for w in wanted:
            x = self.old.get(w)
            if x is None:
                split[w] = self.parts(w)
            else:
                found[w] = x
        cores: dict[str, bytes] = {}
        unseen = []
        for c in {p for pair in split.values() for p in pair}:
            x = self.new.get(c) or found.get(c) or self.old.get(c)
            if x is None and c:
                unseen.append(c)
            else:
                cores[c] = x or b""
        for at in range(0, len(unseen), NEW_WORDS):
            cores.update(self._ids(unseen[at : at + NEW_WORDS]))
        found.update((w, cores[a] + cores[b]) for w, (a, b) in split.items())
        kept = {w: b for many in (cores, found) for w, b in many.items() if len(w) <= MOST_CACHED_CHARS}
        size = sum(map(len, kept)) + sum(map(len, kept.values())) + _ENTRY_BYTES * len(kept)
        if self.held + size > self.most:
            self.old, self.new, self.held = self.new, {"": b""}, 0
        if size <= self.most:
            self.new.update(kept)
            self.held += size
        return found

    def encode(self, batch: list[str]) -> list[bytes]:
        """Packed ids of each text. Makes no cycles, so the collector, which would visit each word, rests meanwhile."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode(batch)
        finally:
            if was:
                gc.enable()

    def _encode(self, batch: list[str]) -> list[bytes]:
        out = [[] for _ in batch]
        for at, text in enumerate(batch):
            for piece in pieces(text):
                out[at].append(piece.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
                if len(piece) >= PIECE // 2:  # a long text's words don't wait for the others
                    out[at] = [*out[at][:-1], self._join([out[at][-1]])[0]]
        words = [x for parts in out for x in parts if type(x) is list]
        ready = iter(self._join(words))
        return [b"".join(next(ready) if type(x) is list else x for x in parts) for parts in out]

    def _join(self, many: list[list[str]]) -> list[bytes]:
        get = self.new.get
        got, gaps, wanted = [], [], set()
        for words in many:
            ids = list(map(get, words))
            at = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            wanted.update([words[i] for i in at])
            got.append(ids)
            gaps.append(at)
        more = self._learn(wanted) if wanted else {}
        for words, ids, at in zip(many, got, gaps):
            for i in at:
                ids[i] = more[words[i]]
        return list(map(b"".join, got))


def pieces(text: str, most: int = PIECE):
    """A text in pieces of about `most` characters, cut at blanks."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


_ENCODERS: dict[tuple[int, str], WordEncoder] = {}


def encoder(model: bytes, kind: str) -> WordEncoder:
    """One encoder, with the bounded number of words that it remembers, for each Python worker and tokenizer."""
    key = (hash(model), kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(model, kind)
    return _ENCODERS[key]


def _model(path: str) -> tuple[bytes, str]:
    with open(path, "rb") as f:
        data = f.read(MOST_MODEL_BYTES + 1)
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MOST_MODEL_BYTES} bytes")
    most = max(Tokenizer.from_str(data.decode()).get_vocab(with_added_tokens=True).values())
    return data, "<u2" if most < 1 << 16 else "<u4"


def write_ids(docs: DataFrame, tokenizer_file: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Writes id files below `folder` (a URI that all machines reach) and returns the manifest, a row for each shard:
    part, path, kind, n_docs, n_null, n_ids, first_key, last_key. part orders the shards.

    Documents are ordered by key (null keys first, equal keys by a hash of the text) by range partitioning, so shards
    are even and a shard is one task's. Each whole text's ids, then end_id, are appended to `<path>.ids` as little-endian
    integers of 16 bits (32 for a larger vocabulary); `<path>.idx` has perfect hash, fingerprints, places and offsets. A
    null or empty text is the end id alone. Rows with a null key are written first. Each attempt of a task writes under
    a name of its own and the manifest, a checkpoint, names the files of the attempts that succeeded. An empty table
    gives an empty manifest. Only key and text are read; a very long text is encoded in pieces.
    """
    model, kind = _model(tokenizer_file)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t")).repartitionByRange("k", "h").sortWithinPartitions("k", "h")

    def run(batches):
        words, out = None, None
        keys, known, lengths = [], [], []
        end = np.array([end_id], kind).tobytes()
        width = len(end)
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}"
        for batch in slices(batches):
            if out is None:
                words = encoder(sent.value, kind)
                store, where = fs.FileSystem.from_uri(path)
                store.create_dir(where.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(where + ".ids")
            payload = [p + end for p in words.encode(texts(batch.column(1)))]
            out.write(b"".join(payload))
            k = batch.column(0)
            known.append(k.is_valid().to_numpy(zero_copy_only=False))
            keys.append(k.fill_null(0).to_numpy(zero_copy_only=False))
            lengths.append(np.array([len(p) // width for p in payload], np.int64))
        if out is None:
            return
        out.close()
        keys, known, ends = np.concatenate(keys), np.concatenate(known), np.cumsum(np.concatenate(lengths))
        real = keys[known]
        with store.open_output_stream(where + ".idx") as f:
            f.write(Index.of(real, len(keys) - len(real), ends).dump())
        first, last = (int(real[0]), int(real[-1])) if len(real) else (None, None)
        yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "kind": kind, "n_docs": len(keys), "n_null": len(keys) - len(real), "n_ids": int(ends[-1]), "first_key": first, "last_key": last}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("kind", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]))

    return checkpointed(ordered.mapInArrow(run, "part int, path string, kind string, n_docs long, n_null long, n_ids long, first_key long, last_key long"))


def _open(path: str) -> tuple[Index, object]:
    """A shard's index, mapped where the store is local and read once where it isn't, and its id file."""
    store, where = fs.FileSystem.from_uri(path)
    if store.type_name == "local":
        return Index.view(pa.memory_map(where + ".idx").read_buffer()), store.open_input_file(where + ".ids")
    with store.open_input_file(where + ".idx") as f:
        return Index.view(f.read_buffer()), store.open_input_file(where + ".ids")


def _shards(manifest: DataFrame) -> list[tuple]:
    """(path, kind, ids in the shards before, documents without a key, first key, last key), in order; a row a shard."""
    out, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        out.append((r.path, r.kind, start, r.n_null, r.first_key, r.last_key))
        start += r.n_ids
    return out


#: Ids that a task holds at once while it reads documents.
READ_IDS = 1 << 20


def _documents(shard: tuple, index: Index, f, keys: list, places: np.ndarray, key: str, with_ids: bool):
    """Arrow batches of the documents at these places: key, start, n_tokens, ids_crc32, and ids if they are wanted."""
    width = np.dtype(shard[1]).itemsize
    begin, end = index.spans(places)
    size, a = end - begin, 0
    total = np.cumsum(size)
    while a < len(places):
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + READ_IDS, "right")))
        data = []
        for x, n in zip(begin[a:b].tolist(), size[a:b].tolist()):
            f.seek(x * width)
            data.append(np.frombuffer(f.read(n * width), shard[1]).astype("<u4"))
        cols = [pa.array(keys[a:b], pa.int64()), pa.array(shard[2] + begin[a:b]), pa.array(size[a:b]), pa.array([zlib.crc32(d) for d in data], pa.int64())]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int32)), pa.array(np.concatenate(data).astype(np.int64))))
        yield pa.RecordBatch.from_arrays(cols, names=[key, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
        a = b


def _schema(key: str, with_ids: bool) -> str:
    return f"`{key}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")


def lookup(manifest: DataFrame, keys: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The documents of the wanted keys, each found in constant time through its shard's perfect hash and fingerprint:
    key, start (ids before it in all shards), n_tokens, ids_crc32 and, if wanted, ids.

    Keys are dealt by shard (the manifest, a row a shard, is collected) and asked for once each, however often they are
    wanted; a key that several documents have gives a row for each of them. Null and unknown keys give none, but for
    the fingerprints' odds (see Index). Without files or keys there are no rows.
    """
    shards = _shards(manifest)
    with_keys = [i for i, s in enumerate(shards) if s[4] is not None]
    first, last = np.array([shards[i][4] for i in with_keys], np.int64), np.array([shards[i][5] for i in with_keys], np.int64)

    def deal(batches):
        for batch in batches:
            k = np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            lo, hi = np.searchsorted(last, k, "left"), np.searchsorted(first, k, "right")
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, n)), pa.array(np.array(with_keys, np.int32)[at] if len(at) else at.astype(np.int32))], names=[key, "shard"])

    def read(batches):
        at, index, f, before = -1, None, None, None
        for batch in batches:
            k, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in _runs(s):
                if s[a] != at:
                    at, before = int(s[a]), None
                    index, f = _open(shards[at][0])
                own = k[a:b]
                own = own[np.concatenate([[before is None or own[0] != before], own[1:] != own[:-1]])]
                before = k[b - 1]
                place, n = index.find(own)
                places = np.repeat(place, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield from _documents(shards[at], index, f, np.repeat(own, n), places, key, with_ids)

    dealt = keys.select(F.col(key).cast("long").alias(key)).mapInArrow(deal, f"`{key}` long, shard int")
    return dealt.repartition("shard").sortWithinPartitions("shard", key).mapInArrow(read, _schema(key, with_ids))


def _runs(s: np.ndarray):
    """Begin and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(s)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(s)])) if len(s) else []


def without_key(manifest: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The documents whose key is null, as lookup gives the others; they are the first ones of their shards."""
    shards = [s for s in _shards(manifest) if s[3]]
    plan = manifest.sparkSession.createDataFrame([(i,) for i in range(len(shards))], "i int")

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                index, f = _open(shards[i][0])
                for a in range(0, index.n_null, 4096):
                    places = np.arange(a, min(index.n_null, a + 4096))
                    yield from _documents(shards[i], index, f, [None] * len(places), places, key, with_ids)

    return plan.repartition(max(1, len(shards))).mapInArrow(run, _schema(key, with_ids))


def digest(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to files in the shared folder and looks every document up by its key: key, start, n_tokens,
    ids_crc32. Rows without a key, which no lookup finds, are read from their places."""
    manifest = write_ids(docs, tokenizer_file, new_folder(docs.sparkSession, "ids"), key, text)
    found = lookup(manifest, docs, key, with_ids=False)
    return found.unionByName(without_key(manifest, key, with_ids=False)) if manifest.where("n_null > 0").count() else found
