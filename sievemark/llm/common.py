"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import io
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at once, and about how many bytes.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


#: Tasks of a round of components.
LEAST_TASKS, EDGES_PER_TASK = 12, 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: the one in spark.checkpoint.dir. Only a single machine (local mode, as in
    tests) gets a folder of its own where the setting is missing; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, so that lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df computed once and written as Parquet to the shared folder: compressed, and columns are read as needed."""
    folder = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def put_arrays(path: str, **arrays: np.ndarray) -> None:
    """Writes named arrays to one file of a folder that all machines share."""
    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    with io.BytesIO() as f:
        np.savez(f, **arrays)
        with store.open_output_stream(where) as out:
            out.write(f.getbuffer())


def get_arrays(path: str) -> dict[str, np.ndarray]:
    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_file(where) as f, np.load(io.BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches cut to a bounded number of rows, fewer where rows are long."""
    for batch in batches:
        step = min(rows, max(1, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def from_lists(lists: list, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from numpy arrays or lists, without a Python object for each element."""
    ends = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = np.concatenate([np.asarray(x) for x in lists]) if len(lists) and ends[-1] else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


class Forest:
    """Union-find over 0..n-1 within one task; a root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanned(edges: DataFrame) -> DataFrame:
    """Edges (u > v) of a spanning forest of each task's edges: every node that has an edge points at the smallest node
    of its piece. Holds a bounded number of edges at a time, so that a task may give several forests."""

    def run(batches):
        held, n = [], 0

        def stars():
            pairs = np.concatenate(held)
            nodes, at = np.unique(pairs, return_inverse=True)
            forest = Forest(len(nodes))
            for x, y in at.reshape(-1, 2).tolist():
                forest.join(x, y)
            root = np.array([forest.root(i) for i in range(len(nodes))], np.int64)
            tied = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1))
            n += batch.num_rows
            if n >= EDGES_PER_TASK:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    edges: two long columns. Returns (node, component), component the smallest node reachable, for each node with an
    edge to another node. Before the rounds each task replaces its edges by stars of what they connect, once where the
    edges lie and once dealt by the end that isn't the star's centre (which has an edge a task at most). Few edges are
    settled by that; what isn't goes through rounds, each two joins on the node whose hot keys Spark can split (plain
    inner joins after partial aggregates). Rounds grow with the logarithm of the longest chain and are checkpoints.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = checkpointed(spanned(e))
    parts = max(1, -(-e.count() // EDGES_PER_TASK))
    e = checkpointed(spanned(e.repartition(parts, "u")))
    for _ in range(most_rounds):
        if _stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
        # few edges don't need many tasks, each of which leaves files of its own
        parts = max(LEAST_TASKS, -(-e.count() // EDGES_PER_TASK))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # each node's own smallest neighbour is kept as well, so that no link is lost
        large = large.union(low.where("u <> m").select("u", F.col("m").alias("v"))).coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _stars(e: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one or is a centre, not both."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()
