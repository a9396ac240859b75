"""Sources and sinks of files: whole HTML files, questions and papers in JSON, tables as JSON lines and CSV."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_html(pages: DataFrame, folder: str, name: str, html: str) -> DataFrame:
    """Writes each page to `<folder>/<name>.html` and returns (file, bytes), a row a file, which must be read to write.

    A file's name and content follow from its row, so a task that is done again writes the same. Null html is empty.
    """
    def run(batches):
        store, where = fs.FileSystem.from_uri(folder)
        store.create_dir(where, recursive=True)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [(x or "").encode() for x in batch.column(1).to_pylist()]
            for n, t in zip(names, texts):
                with store.open_output_stream(f"{where}/{n}.html") as f:
                    f.write(t)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["file", "bytes"])

    return pages.select(F.col(name).alias("file"), F.col(html).alias("html")).mapInArrow(run, "file string, bytes long")


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, company, year, html) of the HTML files of a folder. A name parts at its last underscore; bytes that
    aren't UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda i: F.regexp_extract(name, r"^(.*)_([^_]*)\.html$", i)
    return files.select(name.alias("source_file"), part(1).alias("company"), part(2).alias("year"), text.alias("html"))


def write_questions(rows: DataFrame, folder: str, split: str) -> None:
    """JSON lines, a folder for each split."""
    rows.withColumnRenamed(split, "_split").write.partitionBy("_split").json(folder)


def read_questions(spark: SparkSession, folder: str, schema: str, splits: list[str] | None = None) -> DataFrame:
    """The questions of all splits, or of the wanted ones (others' folders aren't read), tagged with `_split`."""
    rows = spark.read.schema(f"{schema}, _split string").json(folder)
    return rows.where(F.col("_split").isin(splits)) if splits else rows


_RECORDS = "title string, abstract string, full_text array<struct<section_name:string, paragraphs:array<string>>>"
_ARRAYS = "title string, abstract string, full_text struct<section_name:array<string>, paragraphs:array<array<string>>>"


def paper_sections(papers: DataFrame, json: str, key: str) -> DataFrame:
    """(key, title, section_index, section_name, paragraphs) of papers in JSON, whose full text is a list of records or
    a record of lists; the abstract, if there is one, is the first section. Texts that aren't such papers have no rows."""
    records, arrays = F.from_json(json, _RECORDS), F.from_json(json, _ARRAYS)
    lists = arrays["full_text"]
    zipped = F.transform(F.arrays_zip(lists["section_name"].alias("section_name"), lists["paragraphs"].alias("paragraphs")), lambda x: F.struct(x["section_name"].alias("section_name"), x["paragraphs"].alias("paragraphs")))
    title, abstract = F.coalesce(records["title"], arrays["title"]), F.coalesce(records["abstract"], arrays["abstract"])
    text = F.filter(F.coalesce(records["full_text"], zipped, F.array().cast("array<struct<section_name:string, paragraphs:array<string>>>")), lambda x: x["section_name"].isNotNull() | x["paragraphs"].isNotNull())
    first = F.when(F.trim(F.coalesce(abstract, F.lit(""))) != "", F.array(F.struct(F.lit("Abstract").alias("section_name"), F.array(abstract).alias("paragraphs")))).otherwise(F.array().cast("array<struct<section_name:string, paragraphs:array<string>>>"))
    rows = papers.select(key, title.alias("title"), F.posexplode(F.concat(first, text)).alias("section_index", "s"))
    return rows.select(key, "title", "section_index", F.col("s.section_name").alias("section_name"), F.coalesce("s.paragraphs", F.array().cast("array<string>")).alias("paragraphs"))


def answer_text(record: Column) -> Column:
    """One text of an answer's record: 'unanswerable', the free form, the extracted spans, or yes and no."""
    spans = F.array_join(record["extractive_spans"], "; ")
    said = F.when(record["yes_no"], "yes").when(~record["yes_no"], "no").otherwise("")
    return F.when(F.coalesce(record["unanswerable"], F.lit(False)), "unanswerable").when(F.trim(F.coalesce(record["free_form_answer"], F.lit(""))) != "", record["free_form_answer"]).when(F.coalesce(spans, F.lit("")) != "", spans).otherwise(said)


#: Every field is quoted and quotes are doubled, so that marks and line ends pass through.
_CSV = {"header": "true", "quoteAll": "true", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "\u0001"}


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.options(**_CSV).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).csv(folder)


def append_jsonl(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)
