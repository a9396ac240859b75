"""Secret scans: patterns in each text, and ownership frequency of candidate values over the whole corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, slices, texts

KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidate values beside the base kinds: long unbroken runs, judged by their make-up and by who else has them.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your|test|xxxx|0000|1234|abcd", re.IGNORECASE | re.ASCII)
#: A value that more owners or more repositories than these have is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 1, 3
LEAST_ENTROPY = 3.0


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def live_looking(value: str) -> bool:
    """Letters and digits mixed at high entropy, without the usual words of examples."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= LEAST_ENTROPY and not _PLACEHOLDER.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the three base kinds, by start and then kind."""
    out = []
    low = text.lower()
    # İ and its like grow in lower case; the hints only say whether the pattern can match at all
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end(), *m.span(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), *m.span()) for m in _HEX.finditer(text)]
    return sorted(out)


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


_SCAN = "_row long, n_assign long, n_access long, n_hex long, base array<struct<s:int,k:int,e:int>>, cand array<struct<s:int,e:int,h:long,v:boolean>>, base_h array<long>"


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def candidates(docs: DataFrame, key: str, text: str, repository: str | Column, owner: str | Column) -> DataFrame:
    """One pass over the texts: base spans, hashes of their values, and further candidates. A checkpoint: it is read twice.

    Values leave the task as 64-bit hashes only.
    """
    plain = docs.select(F.col(key), _column(repository).cast("string").alias("_repo"), _column(owner).cast("string").alias("_owner"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))

    def run(batches):
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for x in texts(batch.column(4)):
                base = base_spans(x)
                n = Counter(b[1] for b in base)
                taken = [(b[0], b[2]) for b in base]
                cand, at = [], 0
                for m in _RUN.finditer(x):
                    a, b = m.span()
                    while at < len(taken) and taken[at][1] <= a:
                        at += 1
                    # base spans stay as they are; what overlaps one isn't a further candidate
                    if any(t[0] < b and a < t[1] for t in taken[max(0, at - 2) :][:8]):
                        continue
                    v = m.group()
                    if live_looking(v):
                        cand.append({"s": a, "e": b, "h": _hash(v), "v": True})
                for i, v in enumerate((n[0], n[1], n[2], [{"s": b[0], "k": b[1], "e": b[2]} for b in base], cand, sorted({_hash(x[b[3] : b[4]]) for b in base}))):
                    cols[i].append(v)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())])), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("h", pa.int64()), ("v", pa.bool_())])), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[key, "_repo", "_owner", "_row", "n_assign", "n_access", "n_hex", "base", "cand", "base_h"])

    schema = T.StructType([plain.schema[0], *T._parse_datatype_string("_repo string, _owner string, " + _SCAN).fields])
    return checkpointed(plain.mapInArrow(run, schema))


def ownership(scan: DataFrame) -> DataFrame:
    """(h, n_owners, n_repositories, n_docs) of each candidate value, over all documents.

    Counts are pre-aggregated by value and owner in the reading tasks, so that a value in a third of all documents
    sends one row from each task. A null owner or repository counts as one owner of its own.
    """
    each = scan.select("_owner", "_repo", F.explode(F.array_distinct(F.concat(F.transform("cand", lambda c: c["h"]), "base_h"))).alias("h"))
    by = each.groupBy("h", "_owner", "_repo").agg(F.count("*").alias("n"))
    by = by.groupBy("h", "_owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"), F.sum("n").alias("n_docs"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str | Column = "source", owner: str | Column = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Per row of docs: key, n_assign, n_access, n_hex, n_owned, n_live, n_example, base and all (arrays of start, kind, end).

    Base spans always stay. A further candidate (kind 3, "owned") is added if it looks live and at most `most_owners`
    distinct owners and `most_repositories` distinct repositories (of an owner) have its value anywhere in the corpus.
    n_live counts the row's distinct base values that so few have, n_example those that more have. Null or empty texts
    have no spans, an empty table no rows; very long texts are scanned whole. Null keys and repeated rows stay, a row
    each; copies of a row have one owner. Only key, text, repository and owner (columns or names of columns) are read,
    and other columns' names don't matter.

    Rows are joined by value hash only where they hold candidates; Spark may split a hot value's rows (a plain left join).
    """
    scan = candidates(docs, key, text, repository, owner)
    counts = ownership(scan).select("h", ((F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)).alias("few"))
    wanted = scan.select("_row", F.explode(F.concat(F.transform("cand", lambda c: F.struct(c["h"].alias("h"), c["s"].alias("s"), c["e"].alias("e"))), F.transform("base_h", lambda h: F.struct(h.alias("h"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))))).alias("c")).select("_row", "c.h", "c.s", "c.e")
    judged = wanted.join(counts, "h").groupBy("_row").agg(
        F.count(F.when((F.col("s") < 0) & F.col("few"), 1)).alias("n_live"),
        F.count(F.when((F.col("s") < 0) & ~F.col("few"), 1)).alias("n_example"),
        F.collect_list(F.when((F.col("s") >= 0) & F.col("few"), F.struct("s", F.lit(3).alias("k"), "e"))).alias("more"),
    )
    has = (F.size("cand") > 0) | (F.size("base_h") > 0)
    cols = [key, "n_assign", "n_access", "n_hex"]
    none = F.lit(0).cast("long")
    bare = scan.where(~has).select(*cols, none.alias("n_owned"), none.alias("n_live"), none.alias("n_example"), "base", F.col("base").alias("all"))
    full = scan.where(has).join(judged, "_row").select(*cols, F.size("more").cast("long").alias("n_owned"), "n_live", "n_example", "base", F.array_sort(F.concat("base", "more")).alias("all"))
    return bare.unionByName(full)


def _listed(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_assign", "n_access", "n_hex", F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"), "n_owned", "n_live", "n_example")


def value_span(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """What to overwrite of a span: of an assignment the value, else all."""
    found = _ASSIGN.match(text, start) if kind == 0 else None
    return found.span(2) if found else (start, end)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span (merged where they overlap) replaced by a mark."""
    parts, last = [], 0
    for a, b in sorted(spans):
        if a < last:
            a = last
        if b <= a:
            continue
        parts += [text[last:a], mark]
        last = b
    return "".join([*parts, text[last:]])
