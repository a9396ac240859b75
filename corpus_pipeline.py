"""The corpus pipeline: quality filter, near-duplicates, decontamination, secrets, token ids.

Each stage takes all that the one before it kept. All but the last return the columns of documents. Rows with a null
doc_id or a null text take part like any others; what a stage does with them is said there.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import bpe, decontaminate, ngram_join, quality, secrets
from sievemark.llm.common import checkpointed, slices, table

#: The near-duplicates stage: words in a shingle, and the least similarity as a fraction.
SHINGLE_WORDS, NUM, DEN = 5, 80, 100


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under numbered names, which no operator's columns clash with, and the name that each column has there."""
    names = [f"in_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on the labelled ones among them, scores at 0.7 or more.

    Null and empty texts have a score like others; without labels all score 0.5 and go. An empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own, at = numbered(docs)
    return quality.score(own, model, at["doc_id"], at["text"], carry=True).where("predicted = 1").select(*own.columns).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that the n-gram join links, directly or by others, the one with the smallest doc_id stays.

    Here two documents link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; op6's own rule
    is three words and 0.9. A document is a doc_id with a text, named by a 64-bit hash of both: rows of one doc_id with
    other texts are other documents, of which one with a smaller hash stays if they link; of repeated documents one row
    stays, that with the smallest hash of its columns. Rows with a null doc_id link with nothing and all stay, and so do
    empty texts. An empty table stays empty.
    """
    own, at = numbered(docs)
    key, text = F.col(at["doc_id"]), F.col(at["text"])
    own = own.withColumn("name", F.when(key.isNotNull(), F.xxhash64(key, text)))
    grouped = ngram_join.ngram_components(own, "name", at["text"], size=SHINGLE_WORDS, num=NUM, den=DEN).where("name is not null")
    groups = checkpointed(grouped.groupBy("name").agg(F.first("component_id").alias("component"), F.count("*").alias("n")))
    first = own.where(key.isNotNull()).select("name", key.alias("id")).join(groups, "name")
    stay = checkpointed(first.groupBy("component").agg(F.min(F.struct("id", "name", "n")).alias("x")).select("x.name", "x.n"))
    again = stay.where("n > 1").select("name")
    others = groups.join(stay.where("n = 1"), "name", "left_anti").select("name")
    single = own.where(key.isNotNull()).join(few(others), "name", "left_anti").select(*at.values())
    row = F.struct(*at.values())
    repeated = own.join(few(again), "name", "left_semi").groupBy("name").agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return single.unionByName(repeated).unionByName(own.where(key.isNull()).select(*at.values())).toDF(*docs.columns)


#: Documents' names or spans that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def few(rows: DataFrame, values: Column | None = None) -> DataFrame:
    """rows, to be broadcast if their number (of rows, and of values that they hold) is within bounds: then texts needn't
    be shuffled to be joined with them."""
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum(values if values is not None else F.lit(1)), F.lit(0))).first()
    return F.broadcast(rows) if max(n, held) <= MOST_BROADCAST else rows


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the contaminated documents: those of whose words benchmark windows hit at least a twentieth.

    Null and empty texts have no words and stay; an empty table stays empty.
    """
    own, at = numbered(docs)
    found = decontaminate.find(own, table(spark, sf_dir, "benchmark"), at["doc_id"], at["text"], carry=True)
    return found.where(~F.col("contaminated")).select(*own.columns).toDF(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Overwrites every secret in the texts with a mark (of an assignment its value only) and counts n_chars anew.

    Secrets of the base kinds are found where the text is read. Those that the whole corpus decides on are found for
    each (doc_id, text) by the scan; only documents that have such a secret are joined to their texts. Null texts stay
    null and an empty table empty.
    """
    own, at = numbered(docs)
    key, text = F.col(at["doc_id"]), F.col(at["text"])
    own = own.withColumn("name", F.struct(key.alias("id"), F.xxhash64(text).alias("hash")))
    scan = secrets.scan_secrets(own, key="name", text=at["text"], repository=F.concat_ws("/", at["source"], at["lang"]), owner=at["source"])
    more = checkpointed(scan.where("n_owned > 0").select("name", F.filter("all", lambda x: x["k"] == 3).alias("more")).groupBy("name").agg(F.first("more").alias("more")))
    more = more.select(F.col("name").alias("found"), "more")
    both = own.join(few(more, F.size("more")), F.col("name").eqNullSafe(F.col("found")), "left").select(*at.values(), "more")
    names = list(at.values())
    where, count = names.index(at["text"]), names.index(at["n_chars"])

    def run(batches):
        for batch in slices(batches):
            text, n = batch.column(where).to_pylist(), batch.column(count).to_pylist()
            for i, added in enumerate(batch.column(len(names)).to_pylist()):
                spans = [x[3:] if x[1] == 0 else (x[0], x[2]) for x in secrets.base_spans(text[i] or "")]
                spans += [(x["s"], x["e"]) for x in added or ()]
                if spans:
                    text[i] = secrets.redact(text[i], spans)
                    n[i] = len(text[i])
            new = {where: pa.array(text, pa.string()), count: pa.array(n, batch.column(count).type)}
            yield pa.RecordBatch.from_arrays([new.get(i, batch.column(i)) for i in range(len(names))], names=names)

    return both.mapInArrow(run, own.select(*names).schema).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of every whole text; null and empty texts have no ids."""
    out = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("token_ids", token_ids),
]
#: No SQL can say what the classifier and the tokenizer do; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
