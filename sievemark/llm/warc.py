"""WARC archives: a writer of response and revisit records, and a Spark data source that reads them."""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .common import checkpointed, new_folder, raw, slices

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
_URN = "<urn:record:"
_PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


# -- writing
def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field "sl" holds its own size and that of the data, so that readers can skip it."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    size = 12 + 12 + len(packed) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def _clean(value: str | None) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", least_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record for each row into gzipped archives below `folder` and returns the manifest (path, n), a checkpoint.

    Of rows with equal payloads of at least `least_revisit_bytes` bytes the largest key is the response, the others
    are revisits of it and hold no payload; shorter payloads are all responses. A null payload is empty. Rows with a null
    key are responses; repeated rows with the largest key are each a response. Payloads are grouped by SHA-1 and length
    with counts pre-aggregated in the reading tasks, then joined to the rows by digest: one shuffle of the payloads,
    whose hot digests Spark may split. Each attempt writes files of its own; the manifest names those that count. An
    empty table gives an empty manifest; a long payload is one record. Only the three columns are read.
    """
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(uri).cast("string").alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    rows = rows.select("k", "u", "p", F.sha1("p").alias("d"), F.octet_length("p").cast("long").alias("n"))
    first = rows.where(F.col("k").isNotNull() & (F.col("n") >= least_revisit_bytes)).groupBy("d", "n").agg(F.max("k").alias("kept"), F.count("*").alias("c")).where("c > 1").select("d", "n", "kept")
    both = rows.join(first, ["d", "n"], "left").select("k", "u", "p", "d", "n", F.when(F.col("k") < F.col("kept"), F.col("kept")).alias("ref"))

    def run(batches):
        store = out = None
        path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in slices(batches, 256):
            if out is None:
                store, where = fs.FileSystem.from_uri(path)
                store.create_dir(where.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(where, compression=None)
            done = []
            cols = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), *[batch.column(i).to_pylist() for i in (3, 4, 5)]]
            for k, u, p, d, size, ref in zip(*cols):
                d = base64.b32encode(bytes.fromhex(d)).decode()
                rid, to = f"{_URN}{'' if k is None else k}>", None if ref is None else f"{_URN}{ref}>"
                done.append(member(record("response" if ref is None else "revisit", rid, _clean(u), d, p if ref is None else b"", size, to)))
            out.write(b"".join(done))
            n += len(done)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n": n}])

    return checkpointed(both.mapInArrow(run, "path string, n long"))


# -- reading
class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcSource(DataSource):
    """spark.read.format("warc"): options path (a folder or file URI), paths (several, one a line), payload ("false":
    payloads are neither decoded nor returned), files_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


class WarcReader(DataSourceReader):
    """Plans whole files; tests of record type and headers are pushed down and decided before a payload is decoded."""

    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", ("",))
            known = _PUSHED.get(name[0]) if len(name) == 1 else name[1].lower() if len(name) == 2 and name[0] == "headers" else None
            if known and isinstance(f, EqualTo | StringStartsWith) and isinstance(f.value, str):
                self.tests.append((known, (f.value,), isinstance(f, StringStartsWith)))
            elif known and isinstance(f, In) and all(isinstance(x, str) for x in f.value):
                self.tests.append((known, tuple(f.value), False))
            else:
                yield f

    def partitions(self):
        listed = [x for x in self.options.get("paths", "").split("\n") if x]
        if not listed:
            store, where = fs.FileSystem.from_uri(self.options["path"])
            info = store.get_file_info(where)
            found = [info] if info.is_file else store.get_file_info(fs.FileSelector(where, recursive=True))
            listed = sorted("file://" + i.path if store.type_name == "local" else self.options["path"].partition(where)[0] + i.path for i in found if i.is_file and i.path.endswith((".warc", ".warc.gz")))
        each = int(self.options.get("files_per_partition", 1))
        return [_Part(listed[i : i + each]) for i in range(0, len(listed), each)] or [_Part([])]

    def _wanted(self, head: dict[str, str]) -> bool:
        for name, values, prefix in self.tests:
            have = head.get(name)
            if have is None or not (have.startswith(values) if prefix else have in values):
                return False
        return True

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        keep = self.options.get("payload", "true").lower() != "false"
        rows, size = [], 0
        for path in partition.paths:
            for head, body in records(path, self._wanted, keep):
                length = head.get("x-payload-length", head.get("content-length"))
                rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-payload-digest"), int(length) if length and length.isdigit() else None, head.get("warc-refers-to"), list(head.items()), body))
                size += len(body or b"") + 600
                if len(rows) >= 2000 or size >= 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _head(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()}


def records(path: str, wanted=lambda head: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload or None) of the wanted records of a file, gzipped by member or plain.

    Headers are parsed first. An unwanted record of a plain file is passed over by its length, one of a gzipped file by
    the member's stated size; members without a stated size are inflated in pieces that aren't kept.
    """
    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_file(where) as f:
        total, at = f.size(), 0
        zipped = f.read_at(2, 0) == b"\x1f\x8b"
        while at < total:
            if zipped:
                sized = _stated(f.read_at(24, at))
                inflate, block, pos = zlib.decompressobj(31), b"", at
                while b"\r\n\r\n" not in block and not inflate.eof and pos < total:
                    chunk = f.read_at(1 << 12 if sized else 1 << 16, pos)
                    pos += len(chunk)
                    block += inflate.decompress(chunk)
                head_block, _, rest = block.partition(b"\r\n\r\n")
                head = _head(head_block)
                n = int(head.get("content-length", 0))
                use = wanted(head)
                if use and payload:
                    parts, have = [rest], len(rest)
                    while have < n and not inflate.eof:
                        step = min(1 << 20, max(1 << 14, (at + sized - pos) if sized else 1 << 18))
                        chunk = f.read_at(step, pos)
                        if not chunk:
                            break
                        pos += len(chunk)
                        parts.append(inflate.decompress(chunk))
                        have += len(parts[-1])
                    yield head, b"".join(parts)[:n]
                elif use:
                    yield head, None
                if sized:
                    at += sized
                else:
                    while not inflate.eof and pos < total:
                        chunk = f.read_at(1 << 18, pos)
                        pos += len(chunk)
                        inflate.decompress(chunk)
                    at = pos - len(inflate.unused_data)
            else:
                block, pos = b"", at
                while b"\r\n\r\n" not in block and pos < total:
                    block += f.read_at(1 << 14, pos)
                    pos = at + len(block)
                head_block = block.partition(b"\r\n\r\n")[0]
                if not head_block.strip():
                    return
                head = _head(head_block)
                n, begin = int(head.get("content-length", 0)), at + len(head_block) + 4
                if wanted(head):
                    yield head, f.read_at(n, begin) if payload else None
                at = begin + n + 4


def _stated(head: bytes) -> int:
    """The member's whole size from its extra field, 0 if it has none."""
    if len(head) == 24 and head[3] == 4 and head[12:14] == b"sl":
        return struct.unpack_from("<I", head, 16)[0]
    return 0


def read_warc(spark: SparkSession, path: str | None = None, paths: list[str] | None = None, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    return reader.option("paths", "\n".join(paths)).load() if paths is not None else reader.option("path", path).load()


def digest(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads every record of the manifest's files back.

    The record type is pushed down to the source: responses are read with their payloads, revisits by their headers alone.
    An empty table gives no rows; extra columns aren't read.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    manifest = write_warc(pages, folder, key, uri, payload, least_revisit_bytes)
    # a row a file; the folder may hold files of attempts that don't count as well
    paths = sorted(r.path for r in manifest.select("path").toLocalIterator())
    number = lambda c: F.regexp_extract(c, r"<urn:record:(-?\d+)>", 1).try_cast("long")
    if not paths:
        return spark.createDataFrame([], f"`{key}` long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    whole = read_warc(spark, paths=paths).where("record_type = 'response'").withColumn("size", F.octet_length("payload").cast("long"))
    again = read_warc(spark, paths=paths, payload=False).where("record_type = 'revisit'").withColumn("size", F.col("payload_length"))
    columns = [number("record_id").alias(key), F.col("size").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")]
    return whole.select(*columns).unionByName(again.select(*columns))
