"""Exact dedup by Grace hashing: texts dealt into buckets, a bucket's texts compared whole in an open-addressing table."""

from __future__ import annotations

import hashlib
import uuid
from array import array

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, new_folder, raw, slices, written

#: Bytes of texts that one table holds. What a bucket has beyond them goes to spill files.
TABLE_BYTES = 64 << 20
#: Spill files that a bucket is dealt into, by the next FAN_BITS of the hash.
FAN_BITS = 4
#: Bytes gathered for a spill file before they are written.
SPILL_BYTES = 1 << 20

_SPACE = b" \t\n\v\f\r"
_RECORD = pa.schema([("g", pa.int64()), ("h", pa.int64()), ("content", pa.binary())])


class OpenTable:
    """Open addressing with linear probing; an entry is found by its hash and then by its complete content."""

    def __init__(self):
        self.slots, self.mask = array("i", [-1]) * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.names: list[int] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.names)

    def find(self, h: int, content: bytes) -> int:
        """The entry's number, or -1."""
        i = h & self.mask
        while (at := self.slots[i]) >= 0:
            if self.hashes[at] == h and self.contents[at] == content:
                return at
            i = (i + 1) & self.mask
        return -1

    def add(self, h: int, content: bytes, name: int) -> None:
        """content must not be in the table yet."""
        if 2 * len(self.names) > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = array("i", [-1]) * (self.mask + 1)
            for at, x in enumerate(self.hashes):
                self._place(x, at)
        self._place(h, len(self.names))
        self.hashes.append(h)
        self.contents.append(content)
        self.names.append(name)
        self.bytes += len(content)

    def _place(self, h: int, at: int) -> None:
        i = h & self.mask
        while self.slots[i] >= 0:
            i = (i + 1) & self.mask
        self.slots[i] = at


class Spill:
    """One spill file of records in the shared folder; each attempt of a task has files of its own."""

    def __init__(self, folder: str):
        self.store, self.path = fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}")
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.path)
        self.writer = pa.ipc.new_stream(self.out, _RECORD, options=pa.ipc.IpcWriteOptions(compression="lz4"))
        self.held, self.bytes = ([], [], []), 0

    def put(self, record: tuple[int, int, bytes]) -> None:
        for own, x in zip(self.held, record):
            own.append(x)
        self.bytes += len(record[2])
        if self.bytes >= SPILL_BYTES or len(self.held[0]) >= 65536:
            self._write()

    def _write(self) -> None:
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(self.held, _RECORD)], schema=_RECORD))
        self.held, self.bytes = ([], [], []), 0

    def records(self):
        """All records; the file goes when they are read."""
        self._write()
        self.writer.close()
        self.out.close()
        try:
            with self.store.open_input_stream(self.path) as f, pa.ipc.open_stream(f) as stream:
                for batch in stream:
                    yield from zip(*(x.to_pylist() for x in batch.columns))
        finally:
            self.store.delete_file(self.path)


def settle(records, folder: str, table_bytes: int = TABLE_BYTES, depth: int = 0):
    """(g, name) of each record (g, h, content) whose content an earlier record has, whose g is the name.

    The first texts fill the table to its bound. A record that is equal to none of them, when the table is full, goes to
    the spill file of the next bits of its hash; equal texts go to one file. Then each file is a bucket and is settled
    alike. A table takes one text at least, however long, so that this ends.
    """
    table, files = OpenTable(), {}
    for g, h, content in records:
        at = table.find(h, content)
        if at >= 0:
            yield g, table.names[at]
        elif not len(table) or not files and table.bytes + len(content) <= table_bytes:
            table.add(h, content, g)
        else:
            digit = (h >> max(0, 64 - FAN_BITS * (depth + 1))) & ((1 << FAN_BITS) - 1)
            if digit not in files:
                files[digit] = Spill(folder)
            files[digit].put((g, h, content))
    del table
    for digit in sorted(files):
        yield from settle(files.pop(digit).records(), folder, table_bytes, depth + 1)


def _gathered(table_bytes: int):
    """Rows of a task with the number of their group of equal texts in the task; a group's first row has the text."""

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        table, row, group = OpenTable(), first, first
        for batch in slices(batches):
            text = batch.column(1)
            n = pc.fill_null(pc.utf8_length(text), 0)
            groups, digests, contents = [], [], []
            for x in raw(text):
                x = x.translate(None, _SPACE)
                digest = hashlib.sha256(x).digest()
                h = int.from_bytes(digest[:8], "big", signed=True)
                at = table.find(h, x)
                if at < 0:
                    if table.bytes + len(x) > table_bytes:
                        table = OpenTable()
                    table.add(h, x, group)
                    groups.append(group)
                    group += 1
                else:
                    groups.append(table.names[at])
                digests.append(digest)
                contents.append(x if at < 0 else None)
            rows = pa.array(range(row, row + len(groups)), pa.int64())
            row += len(groups)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(groups, pa.int64()), n.cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(contents, pa.binary())], names=["id", "row", "g", "n", "sha", "content"])

    return run


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES, buckets: int | None = None) -> DataFrame:
    """Per row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without the characters space and U+0009-U+000D; a null text counts as empty,
    and so does one of such characters only. Of equal texts the row with the most code points in the original stays,
    then that with the smallest key (nulls last), then, of rows repeated whole, the first; kept is true for exactly one
    row of a group. keep_id is null if all keys of a group are. An empty table gives no rows; other columns aren't read,
    so that none can clash. Long texts are compared whole.

    Each reading task gathers its equal texts in a table first, so that a group of copies of any size leaves it as one
    text a task (or a table of `table_bytes`). These texts are dealt by hash into buckets: `buckets`, or as many as the
    session's shuffle partitions. A bucket larger than a table is dealt on into spill files in the shared folder, as
    often as needed. What comes of a bucket is which group is equal to which, a few numbers; sizes and the row that stays
    are then sums and least values by group, and every row is joined to its task's group, which is never a hot key.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kinds = T.StructType([plain.schema["id"], *(T.StructField(c, T.LongType()) for c in ("row", "g", "n")), *(T.StructField(c, T.BinaryType()) for c in ("sha", "content"))])
    rows = written(plain.mapInArrow(_gathered(table_bytes), kinds), "gathered")
    folder = new_folder(spark, "spill")

    def bucket(batches):
        def records():
            for batch in slices(batches):
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

        found = ([], [])
        for g, name in settle(records(), folder, table_bytes):
            found[0].append(g)
            found[1].append(name)
            if len(found[0]) >= 65536:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["g", "root"])
                found = ([], [])
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["g", "root"])

    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.where("content is not null").select("g", F.xxhash64("sha").alias("h"), "content")
    links = checkpointed(texts.repartition(n, "h").mapInArrow(bucket, "g long, root long"))
    # of a group: rows, and the least of (code points downwards, key, place)
    best = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("null"), "id", "row")
    groups = rows.groupBy("g").agg(F.count("*").alias("size"), F.min(best).alias("best"))
    groups = groups.join(links, "g", "left").withColumn("root", F.coalesce("root", "g"))
    whole = groups.groupBy("root").agg(F.sum("size").alias("size"), F.min("best").alias("best"))
    known = groups.select("g", "root").join(whole, "root").select("g", "size", F.col("best.id").alias("keep"), F.col("best.row").alias("stays"))
    return rows.select("id", "row", "g", "sha").join(known, "g").select(F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("stays")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
