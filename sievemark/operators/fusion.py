"""Fusion, collapse, near-duplicate pairs and balanced selection of ranked rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import checkpointed, once

#: Rows that are broadcast at most; shingles that are ordered by frequency at most (which bounds no result); bits of a
#: set's map at most; sets that are compared in a task.
MOST_BROADCAST, MOST_FREQUENT, MOST_CELLS, BLOCK_SETS = 500_000, 300_000, 1 << 14, 1024


def rrf(vector: DataFrame, lexical: DataFrame, qid: str = "qid", key: str = "doc_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: both ranks, rrf and rank; ties by vector score (missing: 0), then key."""
    both = vector.select(qid, key, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score")).join(lexical.select(qid, key, "bm25_rank", "bm25_score"), [qid, key], "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    fused = both.withColumn("rrf", F.round(part("vector_rank") + part("bm25_rank"), 9))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("rrf"), F.desc(F.coalesce("vector_score", F.lit(0.0))), key)))


def collapse(ranked: DataFrame, parent: str, order: list[Column], qid: str = "qid") -> DataFrame:
    """The best row of each parent."""
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(qid, parent).orderBy(*order))).where("_n = 1").drop("_n")


def collapse_best(ranked: DataFrame, parent: str, score: str, labels: str, qid: str = "qid", key: str = "doc_id", rank: str = "rank") -> DataFrame:
    """(qid, parent, key, score, labels) of each parent: its best row, the best score and the labels of all its rows."""
    each = ranked.withColumn("_l", F.explode_outer(labels))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(rank)).alias("r"), F.col(key).alias("k")))
    out = each.groupBy(qid, parent).agg(best.alias("_b"), F.sort_array(F.collect_set("_l")).alias(labels))
    return out.select(qid, parent, F.col("_b.k").alias(key), F.col("_b.s").alias(score), labels)


def rerank(ranked: DataFrame, scores: DataFrame, qid: str = "qid", key: str = "doc_id") -> DataFrame:
    """Rows with a model score come first, by it; the others keep their order after them."""
    both = ranked.withColumnRenamed("rank", "prior_rank").join(scores.select(qid, key, "rerank_score"), [qid, key], "left")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc_nulls_last("rerank_score"), "prior_rank", key)))


def rerank_or_keep(ranked: DataFrame, scores: DataFrame, qid: str = "qid", key: str = "doc_id") -> DataFrame:
    """rerank, with a warning for queries that the model gave no score at all; these keep their order."""
    scored = scores.select(qid).distinct().withColumn("_scored", F.lit(True))
    return rerank(ranked, scores, qid, key).join(scored, qid, "left").withColumn("warning", F.when(F.col("_scored"), "").otherwise("rerank_failed")).drop("_scored")


def promote(ranked: DataFrame, exact: DataFrame, qid: str = "qid", key: str = "doc_id") -> DataFrame:
    """Rows of exact matches come first with a score of 1 at least, then the rest in order; exact: (qid, key)."""
    both = ranked.join(exact.select(qid, key).distinct().withColumn("_exact", F.lit(0)), [qid, key], "full")
    tier = F.coalesce("_exact", F.lit(1))
    w = Window.partitionBy(qid).orderBy(tier, F.asc_nulls_last("rank"), key)
    return both.withColumns({"promoted": tier == 0, "final_rank": F.row_number().over(w)}).drop("_exact")


def multi_query(hits: DataFrame, qid: str = "qid", key: str = "doc_id") -> DataFrame:
    """One row for each chunk: the best score and the union of its task ids."""
    return hits.groupBy(qid, key).agg(F.max("score").alias("score"), F.sort_array(F.collect_set("task_id")).alias("task_ids"))


def near_duplicates(docs: DataFrame, num: int = 82, den: int = 100, key: str = "doc_id", tokens: str = "tokens", groups: tuple[str, ...] = ("source",), size: int = 5, least: int = 20) -> DataFrame:
    """Pairs (a, b, jaccard) of documents of one group whose shingle sets have a Jaccard similarity of num / den or more.

    Equal sets are one class first, whose members are paired with the class's first only, so that copies don't pair with
    each other. A set that links shares one of its rarest n - need + 1 shingles with its partner, so only these are
    shuffled and joined; what the sets' bit maps don't rule out is counted where a block of sets meets. Documents of fewer
    than `least` tokens take no part.
    """
    near, copies = _near_pairs(docs, num, den, key, tokens, groups, size, least)
    return near.unionByName(copies)


def _near_pairs(docs: DataFrame, num: int, den: int, key: str, tokens: str, groups: tuple[str, ...], size: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets, by the first of each class, and of classes' firsts with their other members."""
    own = once(docs, **{tokens: F.col(tokens)}).where(F.size(tokens) >= least)
    # tokens are zipped with themselves, not looked up by position, so that they are made once for each row
    ahead = F.arrays_zip(*[F.slice(F.col(tokens), i + 1, 1 << 30).alias(f"t{i}") for i in range(size)])
    shingle = F.transform(F.slice(ahead, 1, F.greatest(F.lit(1), F.size(tokens) - (size - 1))), lambda x: F.xxhash64(x))
    sets = own.select(key, *groups, F.sort_array(F.array_distinct(shingle)).alias("s"))
    # the sets are made and written once; all that follows reads them, and shuffles what it needs of them only
    known = F.lit(True)
    for c in groups:
        known = known & F.col(c).isNotNull()
    named = checkpointed(sets.select(key, F.when(known, F.xxhash64(F.lit(0), *groups)).alias("g"), "s", F.sha2(F.to_json(F.struct("s", *groups)), 256).alias("h")))
    first = checkpointed(named.groupBy("h").agg(F.min(key).alias("first")))
    copies = checkpointed(named.select(key, "h").join(first, "h").where(F.col(key) != F.col("first")).select(F.col("first").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("jaccard")))
    gone, stay = copies.select(F.col("b").alias(key)), first.select(F.col("first").alias(key))
    reps = named.where("g is not null").select(key, "g", "s")
    reps = reps.join(_few(gone), key, "left_anti") if gone.count() <= MOST_BROADCAST else reps.join(_few(stay), key, "left_semi")
    rare = _prefixes(reps, _frequent(reps), num, den, key)
    a, b = rare.toDF("x", "a", "na", "ra"), rare.toDF("x", "b", "nb", "rb")
    # from the place of the first shingle that both have, their sets must hold enough in common
    enough = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) * (den + num) >= (F.col("na") + F.col("nb")) * num
    pairs = a.join(b, "x").where((F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & enough).select("a", "b").distinct()
    near = _counted(checkpointed(_may_link(pairs, _bit_maps(reps, num, den, key), num, den, key)), reps.select(key, "s"), key)
    union = F.col("both") - F.col("i")
    return near.where(F.col("i") * den >= union * num).select("a", "b", F.round(F.col("i") / union, 6).alias("jaccard")), copies


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few, so that sets needn't be shuffled to be joined with them."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists and where each list begins and ends."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _slices(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in some 2048 rows, sorted, and the rank of each, rarer ones first. Only orders prefixes."""

    def run(batches):
        for batch in _slices(batches, 2048):
            x, c = np.unique(_flat(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[c > 3], pa.int64()), pa.array(c[c > 3], pa.int64())], names=["x", "c"])

    counted = sets.select("s").mapInArrow(run, "x long, c long").groupBy("x").agg(F.sum("c").alias("c"))
    top = counted.orderBy(F.desc("c"), "x").limit(MOST_FREQUENT).toPandas()
    x, c = top["x"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    by, rank = np.argsort(x), np.empty(len(x), np.int64)
    rank[np.lexsort((x, c))] = np.arange(len(x))
    return x[by], rank[by]


def _prefixes(sets: DataFrame, order: tuple[np.ndarray, np.ndarray], num: int, den: int, key: str) -> DataFrame:
    """(x, key, n, r) of each set's rarest shingles, as many as one of them must be shared: a name of shingle and group,
    the set's size and the shingle's place in it, from 0. Names of two groups may clash, which costs a pair to compare."""
    sent = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        known, ranks = sent.value
        for batch in _slices(batches, 512):
            x, ends = _flat(batch.column(2))
            n = np.diff(ends)
            row = np.repeat(np.arange(len(n)), n)
            rank = np.full(len(x), -1, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                rank = np.where(known[at] == x, ranks[at], -1)
            by = np.lexsort((x, rank, row))
            r = np.arange(len(x)) - ends[row]
            keep = r < (n - -(-n * num // den) + 1)[row]
            x, row, r = x[by][keep], row[keep], r[keep]
            x = x ^ batch.column(1).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column(0).take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(r.astype(np.int32))], names=["x", key, "n", "r"])

    kind = sets.schema[key].dataType.simpleString()
    return sets.select(key, "g", "s").mapInArrow(run, f"x long, `{key}` {kind}, n int, r int")


def _bit_maps(sets: DataFrame, num: int, den: int, key: str) -> DataFrame:
    """(key, g, n, map) of each set: a bit for each cell of the hash range, whether an odd number of its shingles is there,
    four cells or more for each shingle by which linked sets may differ. Bits in which two maps differ, the longer one
    folded, are at most the shingles in which the sets do."""

    def run(batches):
        for batch in _slices(batches, 512):
            x, ends = _flat(batch.column(2))
            maps, n = [], np.diff(ends)
            for i, k in enumerate(n.tolist()):
                cells = min(MOST_CELLS, max(64, 1 << max(0, 4 * (2 * k * (den - num) // (den + num)) - 1).bit_length()))
                odd = np.bincount(x[ends[i] : ends[i + 1]] & (cells - 1), minlength=cells) & 1
                maps.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int32)), pa.array(maps, pa.binary())], names=[key, "g", "n", "map"])

    kind = sets.schema[key].dataType.simpleString()
    return checkpointed(sets.select(key, "g", "s").mapInArrow(run, f"`{key}` {kind}, g long, n int, map binary"))


def _may_link(pairs: DataFrame, maps: DataFrame, num: int, den: int, key: str) -> DataFrame:
    """The pairs of one group that may link by the sets' bit maps; all that link are among them."""

    def folded(m: np.ndarray, words: int) -> np.ndarray:
        while m.shape[1] > words:
            m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
        return m

    def run(batches):
        for batch in _slices(batches, 4096):
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kind = np.array([len(i) << 20 | len(j) for i, j in zip(x, y)], np.int64)
            gap = np.zeros(len(x), np.int64)
            for k in np.unique(kind).tolist():
                at, words = np.flatnonzero(kind == k), min(k >> 20, k & (1 << 20) - 1) // 8
                p, q = (folded(np.frombuffer(b"".join([m[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1), words) for m in (x, y))
                gap[at] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
            keep = gap * (den + num) <= batch.column(4).to_numpy(zero_copy_only=False) * (den - num)
            yield batch.select([0, 1]).filter(pa.array(keep))

    a, b = maps.toDF("a", "ga", "na", "ma"), maps.toDF("b", "gb", "nb", "mb")
    both = pairs.join(a, "a").join(b, "b").where("ga = gb").select("a", "b", "ma", "mb", (F.col("na") + F.col("nb")).cast("long").alias("both"))
    return both.mapInArrow(run, pairs.schema)


def _counted(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """(a, b, i, both) of each pair (a < b): the size of the intersection and the sizes' sum.

    A pair goes to the place of the smallest partner of its `a`, where most pairs of a group of near copies meet, so that
    each set is sent to few places. Small places share tasks; of large ones both sides are dealt into blocks.
    """
    low = pairs.groupBy("b").agg(F.min("a").alias("low"))
    at = pairs.join(low.withColumnRenamed("b", "a"), "a", "left").select("a", "b", F.xxhash64(F.coalesce("low", "a")).alias("at"))
    held = at.groupBy("at").agg(F.count_distinct("a").alias("u"), F.count_distinct("b").alias("v"))
    many = F.ceil(F.greatest("u", "v") / BLOCK_SETS)
    held = checkpointed(held.select("at", "u", "v", many.alias("m")))
    total = held.where("m = 1").agg(F.sum(F.col("u") + F.col("v"))).first()[0] or 0
    tasks = -(-int(total) // (2 * BLOCK_SETS)) or 1
    block = lambda c: F.when(F.col("m") > 1, F.pmod(F.xxhash64(c), F.col("m"))).otherwise(-1)
    at = at.join(held, "at").select("a", "b", F.when(F.col("m") > 1, F.col("at")).otherwise(F.pmod("at", F.lit(tasks))).alias("at"), block("a").alias("p"), block("b").alias("q"))
    at = checkpointed(at)
    need = checkpointed(at.select("at", "p", "q", F.col("a").alias(key)).union(at.select("at", "p", "q", "b")).distinct())
    sent = sets.join(_few(need), key).select("at", "p", "q", key, "s")
    sent = sent.toDF(*sent.columns)  # columns of its own beside at's

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ends = _flat(right.column("s").combine_chunks())
        row = {k: i for i, k in enumerate(right.column(key).to_pylist())}
        inter, both = [], []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            u, v = (x[ends[row[k]] : ends[row[k] + 1]] for k in (a, b))
            if len(u) > len(v):
                u, v = v, u
            inter.append(int(np.count_nonzero(v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u)))
            both.append(len(u) + len(v))
        return pa.table({"a": left.column("a"), "b": left.column("b"), "i": pa.array(inter, pa.int64()), "both": pa.array(both, pa.int64())})

    kind = sets.schema[key].dataType.simpleString()
    return at.groupBy("at", "p", "q").cogroup(sent.groupBy("at", "p", "q")).applyInArrow(count, f"a {kind}, b {kind}, i long, both long")


def kept_leaders(pairs: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, leader) for each node of the pairs: the greedy pass in ascending order in which a node goes if one before
    it that was kept is its partner. leader: the first such, or the node itself if it was kept.

    pairs: (a, b), a before b. Each round decides all that can be: a node without an undecided or kept partner before it
    is kept, and the partners after it go. Only links between undecided nodes go on, each round a checkpoint; rounds are
    as many as the longest alternation of kept and dropped nodes, not as rows. An error after most_rounds.
    """
    all_ = checkpointed(pairs.select("a", "b").distinct())
    left, kept = all_, None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        now = checkpointed(left.select(F.col("a").alias("node")).distinct().join(left.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
        gone = left.join(now, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
        kept = now if kept is None else kept.unionByName(now)
        decided = checkpointed(now.unionByName(gone))
        # what loses all its undecided partners before it without one of them kept is itself kept
        rest = left.join(decided.withColumnRenamed("node", "b"), "b", "left_anti")
        left_ = checkpointed(rest.join(decided.withColumnRenamed("node", "a"), "a", "left_anti").select("a", "b"))
        free = rest.select(F.col("b").alias("node")).distinct().join(left_.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
        free = checkpointed(free.join(left_.select(F.col("a").alias("node")).distinct(), "node", "left_anti"))
        kept, left = kept.unionByName(free), left_
    else:
        raise RuntimeError(f"the greedy pass did not settle in {most_rounds} rounds")
    nodes = all_.select(F.col("a").alias("node")).union(all_.select("b")).distinct()
    if kept is None:
        return nodes.withColumn("leader", F.col("node"))
    led = all_.join(kept.select(F.col("node").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("first"))
    return nodes.join(kept.withColumn("own", F.col("node")), "node", "left").join(led, "node", "left").select("node", F.coalesce("own", "first").alias("leader"))


def near_kept(docs: DataFrame, num: int = 82, den: int = 100, key: str = "doc_id", tokens: str = "tokens", groups: tuple[str, ...] = ("source",), size: int = 5, least: int = 20) -> DataFrame:
    """(key, kept, leader) of every row: the greedy pass in order of the key that drops what is a near-duplicate (see
    near_duplicates) of a row that was kept, and for a dropped row the first such row, which takes over its tasks.

    A set's copies stand or fall with its first row: they are dropped for it, or for what it is dropped for. So the pass
    runs over different sets only. Keys must be unique; rows of few tokens are kept.
    """
    near, copies = _near_pairs(docs, num, den, key, tokens, groups, size, least)
    led = checkpointed(kept_leaders(near))
    copied = copies.select(F.col("b").alias("node"), "a").join(led.select(F.col("node").alias("a"), "leader"), "a", "left").select("node", F.coalesce("leader", "a").alias("leader"))
    found = led.unionByName(copied)
    out = docs.select(key).join(found, F.col(key) == F.col("node"), "left")
    return out.select(key, F.coalesce(F.col("leader") == F.col(key), F.lit(True)).alias("kept"), F.coalesce("leader", key).alias("leader"))


def balanced(ranked: DataFrame, limit: int, qid: str = "qid", key: str = "doc_id", task: str = "task_id") -> DataFrame:
    """Task-balanced top-k: the best of each task, then other rows with a task, then the rest, `limit` for each query."""
    first = F.row_number().over(Window.partitionBy(qid, task).orderBy("rank", key))
    tier = F.when(F.col(task).isNotNull() & (first == 1), 0).when(F.col(task).isNotNull(), 1).otherwise(2)
    out = ranked.withColumn("tier", tier)
    return out.withColumn("final_rank", F.row_number().over(Window.partitionBy(qid).orderBy("tier", "rank", key))).where(F.col("final_rank") <= limit)


def budget(tasks: Column, cap: int, hybrid: int = 60) -> tuple[Column, Column]:
    """(final top-k, candidate limit): one task at most (3, 12), more min(cap, 2n) and max(16, twice that)."""
    many = F.least(F.lit(cap), 2 * tasks)
    return F.when(tasks <= 1, F.least(F.lit(cap), F.lit(3))).otherwise(many), F.when(tasks <= 1, 12).otherwise(F.greatest(F.lit(16), 2 * many))


def pack(ranked: DataFrame, total: int, each: int, text: str = "text", qid: str = "qid") -> DataFrame:
    """Characters that each document gets of a total budget, in rank order, at most `each` a document."""
    want = F.least(F.length(text), F.lit(each))
    before = F.coalesce(F.sum(want).over(Window.partitionBy(qid).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("given", F.greatest(F.lit(0), F.least(want, F.lit(total) - before)).cast("long")).where("given > 0")
