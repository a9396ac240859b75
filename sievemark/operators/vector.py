"""Vector operators: similarity, exact top-k, ranks with bonuses, an inverted-file index."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import checkpointed

#: Vectors in one block of a matrix product, and bytes of query blocks that are broadcast at most.
BLOCK, MOST_BYTES = 4096, 32 << 20
#: Vectors of a cell of the inverted file on average, least number of cells, and the recall that its probes must reach.
CELL_ROWS, LEAST_CELLS, RECALL = 4096, 16, 0.95
#: Queries that the probes are measured on at most: those with the smallest hash of their id.
AUDIT_QUERIES = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector or different lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def euclidean(a: Column, b: Column) -> Column:
    """Distance; different lengths and nulls are errors."""
    fits = F.coalesce(F.size(a) == F.size(b), F.lit(False)) & a.isNotNull() & b.isNotNull()
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(fits, F.sqrt(gap)).otherwise(F.raise_error(F.lit("vectors must have one length and not be null")).cast("double"))


def _matrix(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of an Arrow list column by length: places and a matrix. Those with nulls, NaN or nothing but zeros are left out."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        good = ~np.isnan(x).any(1) & x.any(1)
        if good.any():
            out[d] = at[good], x[good]
    return out


def _packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(dim, ids, data): blocks of up to BLOCK vectors of one length, each as two binaries."""
    def run(batches):
        for batch in batches:
            for d, (at, x) in _matrix(batch.column(1)).items():
                ids = batch.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False)
                for i in range(0, len(at), BLOCK):
                    yield pa.RecordBatch.from_pylist([{"dim": d, "ids": ids[i : i + BLOCK].tobytes(), "data": x[i : i + BLOCK].tobytes()}], schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "dim int, ids binary, data binary")


def _best(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest finite scores, ties by key."""
    n = score.shape[1]
    floor = np.partition(score, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
    row, col = np.nonzero((score >= floor) & np.isfinite(score))
    by = np.lexsort((keys[col], -score[row, col], row))
    row, col = row[by], col[by]
    first = np.searchsorted(row, np.arange(len(score)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def _block_best(keys: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, digits: int, exclude_self: bool, names: tuple[str, str]):
    """Batches (query, key, score) of the best k of a block of vectors for each of a block of queries."""
    norm = np.sqrt((x * x).sum(1))
    for at in range(0, len(q), 512):  # a bounded part of the product at a time
        y, who = q[at : at + 512], ids[at : at + 512]
        score = np.round((y @ x.T) / np.outer(np.sqrt((y * y).sum(1)), norm), digits)
        if exclude_self:
            score[who[:, None] == keys[None, :]] = -np.inf
        row, col = _best(score, keys, k)
        yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(keys[col]), pa.array(score[row, col])], names=[*names, "score"])


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", qid: str = "qid", digits: int = 9, exclude_self: bool = True) -> DataFrame:
    """Exact top-k by cosine: (qid, key, score, rank), score rounded, ties by key.

    queries: a stated set (qid, vector). Queries and vectors are packed into blocks where they lie; each block of queries
    meets each block of vectors in a task, which multiplies them and sends on its best k a query. Query blocks are
    broadcast while they are within MOST_BYTES, else paired by Spark; the driver sees their number only. Vectors that are
    null or zero, or hold nulls or NaN, and those of another length than the query, have no score. exclude_self: the row
    whose key is the qid.
    """
    own, asked = _packed(vectors, key, vector), _packed(queries, qid, vector).toDF("qdim", "qids", "qdata")
    size = asked.agg(F.coalesce(F.sum(F.length("qdata")), F.lit(0))).first()[0]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dim"]
                if d != r["qdim"]:
                    continue
                keys, ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                x, q = np.frombuffer(r["data"]).reshape(-1, d), np.frombuffer(r["qdata"]).reshape(-1, d)
                yield from _block_best(keys, x, ids, q, k, digits, exclude_self, (qid, key))

    pairs = own.crossJoin(F.broadcast(asked) if size <= MOST_BYTES else asked)
    found = pairs.mapInArrow(run, f"{qid} long, {key} long, score double")
    w = Window.partitionBy(qid).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ivf_cells(vectors: DataFrame, cells: int | None = None, rounds: int = 8, sample: int = 20_000, key: str = "vec_id", vector: str = "embedding") -> tuple[np.ndarray, DataFrame]:
    """Centroids, fitted on a bounded sample (those with the smallest hash of their key), and all rows with their cell.

    Without `cells` their number grows with the table, CELL_ROWS vectors to a cell, up to a tenth of the sample."""
    rows = vectors.where(F.col(vector).isNotNull())
    cells = cells or int(min(sample // 10, max(LEAST_CELLS, rows.count() // CELL_ROWS)))
    some = rows.orderBy(F.xxhash64(key), key).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).toPandas()["v"]
    x = np.array([list(v) for v in some])
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    centre = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        at = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (at == c).any():
                m = x[at == c].mean(0)
                centre[c] = m / max(np.sqrt((m * m).sum()), 1e-300)

    @F.pandas_udf("int")
    def cell(v):
        import pandas as pd

        y = np.array([list(t) for t in v], np.float64)
        return pd.Series((y @ centre.T).argmax(1).astype("int32"))

    return centre, rows.withColumn("cell", cell(F.col(vector)))


def _order(centre: np.ndarray):
    """The cells of a vector, the nearest first."""
    @F.pandas_udf("array<int>")
    def nearest(v):
        import pandas as pd

        y = np.array([list(t) for t in v], np.float64)
        return pd.Series(list(np.argsort(-(y @ centre.T), axis=1, kind="stable").astype("int32")))

    return nearest


def measured_probes(celled: DataFrame, queries: DataFrame, k: int, centre: np.ndarray, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", qid: str = "qid") -> int:
    """Cells that a query must look into so that the share `recall` of true neighbours is found, by exact search for at
    most AUDIT_QUERIES of the queries; all cells where there is nothing to measure."""
    some = queries.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(qid), qid).limit(AUDIT_QUERIES)
    true = knn(celled.select(key, vector), some, k, key, vector, qid).join(celled.select(key, "cell"), key)
    where = true.join(some.select(qid, _order(centre)(F.col(vector)).alias("cells")), qid).select(F.array_position("cells", F.col("cell")).alias("p"))
    held = {r.p: r.n for r in where.groupBy("p").agg(F.count("*").alias("n")).collect()}
    total, seen = sum(held.values()), 0
    for p in range(1, len(centre) + 1):
        seen += held.get(p, 0)
        if total and seen >= recall * total:
            return p
    return len(centre)


def ivf_knn(vectors: DataFrame, queries: DataFrame, k: int, probes: int | None = None, cells: int | None = None, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", qid: str = "qid") -> DataFrame:
    """Approximate top-k: each query looks into its nearest cells; blocks of a cell's vectors and of its queries meet by cell
    and are multiplied, as in knn; scores are exact.

    Without `probes` their number is measured so that `recall` is reached (see measured_probes). Vectors of each length
    that queries have are fitted and searched on their own; those that are null or zero, or hold nulls or numbers that
    aren't finite, have no score."""
    def fine(df: DataFrame) -> DataFrame:
        wide = F.col(vector).cast("array<double>")
        good = (F.size(vector) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(wide, lambda x: x != 0)
        return df.where(F.coalesce(good, F.lit(False)))

    vectors, queries = fine(vectors), fine(queries)
    lengths = sorted(r.d for r in queries.select(F.size(vector).alias("d")).distinct().collect())
    found = [_ivf_of_length(vectors.where(F.size(vector) == d), queries.where(F.size(vector) == d), k, probes, cells, recall, key, vector, qid) for d in lengths]
    none = vectors.where("false").select(F.col(key).alias(qid), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return reduce(DataFrame.unionByName, [x for x in found if x is not None], none)


def _ivf_of_length(vectors: DataFrame, queries: DataFrame, k: int, probes: int | None, cells: int | None, recall: float, key: str, vector: str, qid: str) -> DataFrame | None:
    if vectors.isEmpty():
        return None
    centre, celled = ivf_cells(vectors, cells, key=key, vector=vector)
    celled = checkpointed(celled.select(key, vector, "cell"))
    probes = probes or measured_probes(celled, queries, k, centre, recall, key, vector, qid)
    cells_of = queries.where(F.col(vector).isNotNull()).select(qid, vector, F.explode(F.slice(_order(centre)(F.col(vector)), 1, probes)).alias("cell"))
    own, asked = _packed_cells(celled, key, vector), _packed_cells(cells_of, qid, vector).toDF("cell", "qids", "qdata")
    size = asked.agg(F.coalesce(F.sum(F.length("qdata")), F.lit(0))).first()[0]
    pairs = own.join(F.broadcast(asked) if size <= MOST_BYTES else asked, "cell").repartition(_tasks(celled))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                yield from _block_best(keys, np.frombuffer(r["data"]).reshape(len(keys), -1), ids, np.frombuffer(r["qdata"]).reshape(len(ids), -1), k, 9, True, (qid, key))

    found = pairs.mapInArrow(run, f"{qid} long, {key} long, score double")
    w = Window.partitionBy(qid).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _packed_cells(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(cell, ids, data): blocks of up to BLOCK vectors of one length and one cell. A cell's rows are dealt over a few
    tasks, so that a large cell is not one task's, and each packs its own."""
    def run(batches):
        held, ids, data, n = None, [], [], 0

        def block():
            return pa.RecordBatch.from_pylist([{"cell": held, "ids": np.concatenate(ids).tobytes(), "data": np.concatenate(data).tobytes()}], schema=pa.schema([("cell", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            cells, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for at in np.split(np.arange(len(keys)), cuts):
                for i in range(0, len(at), BLOCK):
                    some = at[i : i + BLOCK]
                    if n and (cells[some[0]] != held or n + len(some) > BLOCK):
                        yield block()
                        ids, data, n = [], [], 0
                    held, n = int(cells[some[0]]), n + len(some)
                    ids.append(keys[some])
                    data.append(x[some])
        if n:
            yield block()

    rows = df.select(F.col("cell").cast("int").alias("cell"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    dealt = rows.repartition(_tasks(df), "cell", F.pmod(F.xxhash64("k"), F.lit(4))).sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "cell int, ids binary, data binary")
