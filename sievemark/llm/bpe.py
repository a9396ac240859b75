"""Byte-level BPE: ids of whole texts by a local rank file, and raw bytes of ids."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import from_lists, slices, texts

#: Characters that a text may have before it is cut at a safe boundary.
PIECE_CHARS = 1 << 16
#: Largest rank file that is sent to the executors, in bytes.
MOST_RANK_BYTES = 64 << 20
# Between a character that isn't white space and one that is, every match of the pattern ends; between a letter and
# what isn't a letter, or a digit and what isn't a digit, too.
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[^\W\d_])(?=[\d\W_])|(?<=\d)(?=\D)")
_NARROW = re.compile(r"(?<=[!-~])(?=[ \n])")
_CODECS: dict[tuple[int, str], tiktoken.Encoding] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} has more than {MOST_RANK_BYTES} bytes")
    return data


def codec(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """One codec for each Python worker and rank file."""
    key = (hash(ranks), pattern)
    if key not in _CODECS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _CODECS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _CODECS[key]


def pieces(text: str, most: int = PIECE_CHARS):
    """Cuts a text where any match of the pattern ends, after `most` characters at the earliest.

    A run without such a boundary stays whole, however long.
    """
    at = 0
    while len(text) - at > most:
        found = _NARROW.search(text, at + most) or _SAFE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str, most: int = PIECE_CHARS) -> list[int]:
    if len(text) <= most:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, most):
        ids += enc.encode_ordinary(piece)
    return ids


def _sent(spark: SparkSession, rank_file: str):
    return spark.sparkContext.broadcast(read_ranks(rank_file))


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "token_ids", n: str = "n_tokens") -> DataFrame:
    """docs with two more columns: token_ids array<int> and n_tokens long.

    A null or empty text gives an empty array and 0. Repeated rows are each encoded. Columns of docs named like the new
    ones are replaced. No shuffle: each task encodes the rows it reads, in slices of a bounded number of rows.
    """
    sent = _sent(docs.sparkSession, rank_file)
    kept = docs.drop(ids, n)
    names = kept.columns
    at = names.index(text)

    def run(batches):
        enc = codec(sent.value, pattern)
        for batch in slices(batches):
            found = [encode(enc, x) for x in texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, from_lists(found, pa.int32()), pa.array([len(x) for x in found], pa.int64())], names=[*names, ids, n])

    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(n, T.LongType())])
    return kept.mapInArrow(run, schema)


def decode_ids(df: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with a binary column: the bytes of each row's ids, which may end inside a character. Null ids: empty bytes."""
    sent = _sent(df.sparkSession, rank_file)

    def run(parts):
        enc = codec(sent.value, pattern)
        for part in parts:
            yield part.map(lambda x: enc.decode_bytes([] if x is None else [int(i) for i in x]))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "binary")(ids))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    Encodes each whole text and decodes the ids within the task; ids don't leave it. Null or empty text: no ids, the
    digests of nothing. Null keys and repeated rows pass through, a row each. Only key and text are read.
    """
    sent = _sent(docs.sparkSession, rank_file)

    def run(batches):
        enc = codec(sent.value, pattern)
        words = [str(i) for i in range(enc.n_vocab)]
        for batch in slices(batches):
            counts, a, b, size = [], [], [], []
            for x in texts(batch.column(1)):
                ids = encode(enc, x)
                back = enc.decode_bytes(ids)
                counts.append(len(ids))
                a.append(hashlib.sha256(" ".join([words[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
                size.append(len(back))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(size, pa.int64())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
