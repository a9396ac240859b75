"""Joins, upserts and listings that several jobs share."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes of a query set that may be broadcast; a larger one is joined by shuffle or in blocks.
MOST_ROWS, MOST_BYTES = 200_000, 32 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and written to the folder in spark.checkpoint.dir, which all machines share. Only local mode
    gets a folder of its own where the setting is missing; on a cluster that is an error."""
    _set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _set_checkpoint_dir(spark) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    sc.setCheckpointDir(found)


def is_small(df: DataFrame) -> bool:
    """Whether df's counted rows and bytes are within the bounds of a broadcast."""
    size = df.select(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))), F.lit(0))).first()
    return size[0] <= MOST_ROWS and size[1] <= MOST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its counted rows and bytes are within bounds, else df as it is."""
    return F.broadcast(df) if is_small(df) else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, or other values of its own, each computed once a row. An array of one row is made a row again, so that Spark copies no
    long expression into each place that reads it, and moves no filter on it before it."""
    made = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.select(*[c for c in df.columns if c not in columns], *[F.col("_once")[n].alias(n) for n in columns])


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores: one of few rows may lie in a single row group, which is a single task. A table
    of more than MOST_ROWS rows stays as it lies. df: as read, so that counting takes no more than its footers."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.count() <= MOST_ROWS else df


def contains_join(rows: DataFrame, items: DataFrame, key: str, text: str, item_key: str, part: str) -> DataFrame:
    """(key, item_key) of a row and an item whose `part` is found in the row's `text`; both are words parted by blanks.

    Rows and items are dealt by an inner word of the item, its longest, which the row must have as a whole word: an
    equality join on words, which gives candidate pairs of keys. Only then are texts joined to them and searched, so that
    no text is sent once for each of its words. Items of fewer than three words, which have no inner word, are a set of
    checked size that is searched in all rows where they lie; a larger set of these is an error. Empty parts match
    nothing. Null texts and parts neither.
    """
    words = F.split(F.col(part), " ")
    inner = F.slice(words, 2, F.size(words) - 2)
    longest = F.element_at(F.array_sort(inner, lambda a, b: F.length(b) - F.length(a)), 1)
    wanted = items.where(F.length(part) > 0).select(item_key, part)
    long_ = wanted.where(F.size(words) >= 3).withColumn("_w", longest)
    short = wanted.where(F.size(words) < 3)
    n = short.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} items of fewer than three words are too many to search in every row")
    keys = small(long_.select("_w").distinct())
    has = rows.select(key, F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("_w")).join(keys, "_w", "left_semi")
    near = has.join(small(long_.select(item_key, "_w")), "_w").select(key, item_key)
    found = near.join(rows.select(key, text), key).join(small(wanted), item_key).where(F.col(text).contains(F.col(part))).select(key, item_key)
    if not n:
        return found
    return found.unionByName(rows.select(key, text).join(F.broadcast(short), F.col(text).contains(F.col(part))).select(key, item_key))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert result: of the rows of a key the one that comes first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key old doesn't have (insert, on conflict do nothing)."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark limits each task's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def round_robin(df: DataFrame, bucket: str, order: list[Column], limit: int) -> DataFrame:
    """A balanced limit: the first of each bucket, then the second of each, and so on, up to `limit` rows."""
    n = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= limit).orderBy("_n", bucket).limit(limit).drop("_n")


def in_order(df: DataFrame, key: str, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of the wanted ids with their position, wanted: (position, id). Unknown ids stay, with found false; with strict
    they are an error that names the first one met."""
    unknown = F.raise_error(F.concat(F.lit("unknown id: "), F.col("id").cast("string"))).cast("boolean") if strict else F.lit(False)
    return wanted.join(df.withColumn("found", F.lit(True)), wanted["id"] == df[key], "left").withColumn("found", F.when(F.col("found"), True).otherwise(unknown))


def manifest(docs: DataFrame, source: str, key: str, text: str, each: int) -> DataFrame:
    """(source, part, bytes, digest): of each range of `each` ids the bytes and a digest of its documents' digests in
    order of their ids. A range is bounded whatever its source's size."""
    own = docs.select(source, F.floor(F.col(key) / each).cast("long").alias("part"), F.octet_length(text).alias("b"), F.struct(F.col(key).alias("k"), F.sha2(text, 256).alias("h")).alias("s"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["h"]), ",")
    return own.groupBy(source, "part").agg(F.sum("b").cast("long").alias("bytes"), F.md5(listed).alias("digest"))


def verified(listed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status) of files against a manifest, both (keys, bytes, sha): ok, missing, unlisted, or what differs first,
    size (which spares reading a digest) or digest."""
    a, b = listed.select(*keys, F.col("bytes").alias("_b1"), F.col("sha").alias("_s1")), found.select(*keys, F.col("bytes").alias("_b2"), F.col("sha").alias("_s2"))
    status = F.when(F.col("_b2").isNull(), "missing").when(F.col("_b1").isNull(), "unlisted").when(F.col("_b1") != F.col("_b2"), "size").when(F.col("_s1") != F.col("_s2"), "digest").otherwise("ok")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new: those whose keys it has replace its own, the others are added."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc("_new")]).drop("_new")


def shared_folder(spark, what: str) -> str:
    """A fresh path in the folder that all machines share (see checkpointed)."""
    import uuid

    sc = spark.sparkContext
    _set_checkpoint_dir(spark)
    return f"{sc.getCheckpointDir().rstrip('/')}/{what}-{uuid.uuid4().hex}"


def replaced(path: str, new: DataFrame, keys: DataFrame, key: str, order: str, index: str = "message_index", buckets: int = 16) -> None:
    """Replaces all rows of the given keys in the table at path by new ones, with a dense index from 0 in order.

    keys: (key) of what is replaced; a key without new rows is deleted. The table lies in folders by a hash of the key;
    only those that hold one of the keys are read, and written anew by dynamic partition overwrite. A repeated call gives
    the same table. path need not exist yet.
    """
    spark, bucket = new.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    dense = (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("int")
    rows = new.join(keys.select(key).distinct(), key, "left_semi").withColumn(index, dense).withColumn("bucket", bucket)
    touched = small(keys.select(bucket.alias("bucket")).distinct())
    try:
        old = spark.read.parquet(path).where(F.col(key).isNotNull()).join(touched, "bucket", "left_semi").join(keys.select(key).distinct(), key, "left_anti")
        # what is kept is read before its folders are overwritten
        rows = checkpointed(rows.unionByName(old.select(*rows.columns)))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    # a folder without rows would not be overwritten: each that is touched gets a row without a key, which readers leave out
    marks = touched.select(*[F.col(c) if c == "bucket" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    rows.unionByName(marks).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_replaced(spark, path: str, key: str) -> DataFrame:
    """The rows of a table that `replaced` writes."""
    return spark.read.parquet(path).where(F.col(key).isNotNull()).drop("bucket")
