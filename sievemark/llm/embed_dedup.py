"""Embedding near-duplicates: one small-world graph per shard, every shard queried, links verified and united."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, checkpointed, components, new_folder
from .hnsw import Graph

LEAST_COSINE = 0.93
SHARD_ROWS = 8192
BEAM = 32
#: Shards that one task searches for a block of vectors, one after the other.
STRIPE = 8
#: Recall of links that a shard's audit must reach, and the queries that it compares with all of the shard at once.
AUDIT_RECALL = 0.995
AUDIT_QUERIES = 128
#: What an audit must have seen before it may pass: true links, and queries with any.
AUDIT_LINKS, AUDIT_LINKED = 600, 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _write(path: str, graph: bytes, exact: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    with io.BytesIO() as f:
        np.savez(f, graph=np.frombuffer(graph, np.uint8), exact=exact, ids=ids, copies=copies)
        with store.open_output_stream(where) as out:
            out.write(f.getbuffer())


def _read(path: str) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_file(where) as f, np.load(io.BytesIO(f.read())) as z:
        return Graph.load(z["graph"].tobytes()), z["exact"], z["ids"], z["copies"]


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """(node, root) of what the pairs connect, roots left out."""
    nodes, at = np.unique(pairs, return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in at.reshape(-1, 2).tolist():
        forest.join(x, y)
    root = np.array([forest.root(i) for i in range(len(nodes))], np.int64)
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[tied], nodes[root[tied]]], 1)


def find_links(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, names: np.ndarray, asked: np.ndarray, beam: int = BEAM, recall: float = AUDIT_RECALL, audit: int = AUDIT_QUERIES) -> list[np.ndarray]:
    """Positions in the shard that each query links with; every one is verified in double precision.

    names, asked: keys of the shard's rows and of the queries; a row of the query's own key isn't a link. Evenly spaced
    queries are compared with the whole shard until AUDIT_LINKS true links at AUDIT_LINKED queries are seen. Where there
    are too few, that compares the whole block, which misses nothing. Otherwise the search must find enough of these
    links; while it doesn't, its beam is doubled, and once it would hold the whole shard, the shard is compared whole.
    """
    n, slack = len(exact), 1e-5
    step = max(1, len(queries) // audit)
    order = np.concatenate([np.arange(i, len(queries), step) for i in range(step)])

    def verified(near: np.ndarray, i: int) -> np.ndarray:
        near = np.sort(near[names[near] != asked[i]])
        return near[exact[near] @ queries[i] >= least]

    truth: dict[int, np.ndarray] = {}

    def compare(some: np.ndarray) -> None:
        for at in range(0, len(some), audit):
            i = some[at : at + audit]
            for j, like in zip(i.tolist(), queries[i] @ exact.T >= least - slack):
                truth[j] = verified(np.flatnonzero(like), j)

    for at in range(0, len(order), audit):
        compare(order[at : at + audit])
        seen = [len(x) for x in truth.values()]
        if sum(seen) >= AUDIT_LINKS and np.count_nonzero(seen) >= AUDIT_LINKED:
            break
    sample = np.array(list(truth), np.int64)
    total, ef = sum(map(len, truth.values())), beam
    while ef < n and len(truth) < len(queries):
        got = graph.near(queries[sample], least - slack, ef)
        if sum(len(np.intersect1d(a, truth[i])) for a, i in zip(got, sample.tolist())) >= recall * total:
            rest = np.setdiff1d(order, sample)
            return [x for _, x in sorted({**truth, **{i: verified(f, i) for i, f in zip(rest.tolist(), graph.near(queries[rest], least - slack, ef))}}.items())]
        ef *= 2
    compare(np.setdiff1d(order, sample))
    return [truth[i] for i in range(len(queries))]


def embed_dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row: key, n_links, component_id, kept.

    Rows are compared if their labels are equal and not null and their vectors have the same length. A vector that is
    null, empty, zero, or holds a null or non-finite component links with nothing, and so does a row with a null key
    (its component is null, kept false). Rows with equal vectors count as vectors linked with each other. Tables
    without rows give no rows; other columns aren't read.

    Equal vectors are first collapsed to their smallest key with a count, so that large groups of copies are one vector.
    What remains of a label is dealt into shards of about `shard_rows` vectors; each shard's graph is built once and
    written to a file of its own in the shared folder (each attempt its own; a checkpoint names those that count). Each
    block of the label's vectors is searched in each shard: a task takes one block and opens STRIPE shards' files in
    turn, so that no graph is shuffled and memory holds one. Links are counted where they are found, and only a spanning
    forest of a task's links leaves it for the components. Long vectors only make blocks larger.
    """
    wide = "array<double>"
    fine = F.coalesce(
        F.col(label).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0)
        & F.forall(F.col(vector).cast(wide), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(F.col(vector).cast(wide), lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).alias("l"), F.size(vector).alias("d")).alias("grp"), F.when(fine, F.col(vector)).alias("vec"))
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), F.reverse("vec"))})
    reps = rows.where("vec is not null").groupBy("grp", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vec").cast(wide).alias("vec"))
    reps = checkpointed(reps)
    sizes = reps.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shard_rows)).cast("int").alias("parts"))
    dealt = reps.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "grp").select("grp", "id", "copies", "vec", "parts", F.pmod(F.xxhash64("id", "h1"), F.col("parts")).cast("int").alias("part"))

    folder = new_folder(vectors.sparkSession, "graphs")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        x = np.array(group["vec"].tolist(), np.float64)
        path = f"{folder}/{uuid.uuid4().hex}"
        _write(path, Graph(_unit(x)).dump(), _unit(x), group["id"].to_numpy(np.int64), group["copies"].to_numpy(np.int64))
        return pd.DataFrame({"l": [str(group["gkey"].iloc[0])], "part": [int(group["part"].iloc[0])], "path": [path]})

    dealt = dealt.withColumn("gkey", F.to_json("grp"))
    flat = dealt.select("gkey", "id", "copies", "vec", "parts", "part")
    graphs = checkpointed(flat.groupBy("gkey", "part").applyInPandas(build, "l string, part int, path string"))
    # the manifest, a row a shard of thousands of vectors, says where each shard's file is
    paths = vectors.sparkSession.sparkContext.broadcast({(r.l, r.part): r.path for r in graphs.toLocalIterator()})
    every = F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / STRIPE).cast("int"))).alias("stripe")
    asked = flat.select("gkey", "id", "vec", F.col("part").alias("block"), every)

    def search(ask: pd.DataFrame) -> pd.DataFrame:
        own = ask["id"].to_numpy(np.int64)
        queries = _unit(np.array(ask["vec"].tolist(), np.float64))
        n_links, pairs = np.zeros(len(own), np.int64), []
        first = int(ask["stripe"].iloc[0]) * STRIPE
        for part in range(first, first + STRIPE):
            path = paths.value.get((str(ask["gkey"].iloc[0]), part))
            if path is None:
                continue
            graph, exact, ids, copies = _read(path)
            for i, others in enumerate(find_links(graph, exact, queries, least, ids, own)):
                n_links[i] += copies[others].sum()
                pairs.append(np.stack([np.full(len(others), own[i]), ids[others]], 1))
            pairs = [_spanning(np.concatenate(pairs))]
        tied = pairs[0] if pairs else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"id": np.concatenate([own, tied[:, 0]]), "links": np.concatenate([n_links, np.zeros(len(tied), np.int64)]), "root": np.concatenate([own, tied[:, 1]])})

    found = checkpointed(asked.groupBy("gkey", "stripe", "block").applyInPandas(search, "id long, links long, root long"))
    linked = components(found.where("id <> root"), "id", "root").withColumnRenamed("node", "id")
    counts = found.groupBy("id").agg(F.sum("links").alias("links")).where("links > 0")
    known = reps.select("grp", "h1", "h2", "id", "copies").join(counts, "id", "left").join(linked, "id", "left").select("grp", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", F.when(F.col("vec").isNotNull(), F.col("grp")).alias("grp"), "h1", "h2").join(known, ["grp", "h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
