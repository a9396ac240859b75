"""Queries that write tables to files in the shared folder and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import checkpointed, shared_folder
from ..sources import files
from .base import query, table


@query("sc01_html_files", r"SELECT 'site_' || (page_id % 7) || '_' || page_id || '.html' AS source_file, 'site_' || (page_id % 7) AS company, CAST(page_id AS VARCHAR) AS year, md5(html) AS html_md5 FROM pages")
def sc01(spark, sf_dir):
    folder = shared_folder(spark, "html")
    name = F.concat(F.lit("site_"), (F.col("page_id") % 7).cast("string"), F.lit("_"), F.col("page_id").cast("string"))
    checkpointed(files.write_html(table(spark, sf_dir, "pages").withColumn("name", name), folder, "name", "html"))
    return files.read_html(spark, folder).select("source_file", "company", "year", F.md5("html").alias("html_md5"))


@query("sc02_question_scan", "SELECT conv_id, turn, role AS _split, md5(text) AS text_md5 FROM conversations WHERE role IN ('user', 'system')")
def sc02(spark, sf_dir):
    """Turns written as questions in JSON, a split a role, and two of the splits read back."""
    folder = shared_folder(spark, "questions")
    files.write_questions(table(spark, sf_dir, "conversations"), folder, "role")
    back = files.read_questions(spark, folder, "conv_id long, turn long, text string", ["user", "system"])
    return back.select("conv_id", "turn", "_split", F.md5("text").alias("text_md5"))


@query("sc03_paper_json", "WITH p AS (SELECT conv_id, turn, text, role FROM conversations) SELECT conv_id, 0 AS section_index, 'Abstract' AS section_name, md5(min(text) FILTER (WHERE turn = 0)) AS text_md5 FROM p GROUP BY conv_id HAVING bool_or(turn = 0 AND text <> '') UNION ALL SELECT p.conv_id, CAST(row_number() OVER (PARTITION BY p.conv_id ORDER BY turn) - CASE WHEN a THEN 0 ELSE 1 END AS INT), role, md5(text || chr(10) || 'end') FROM p JOIN (SELECT conv_id, bool_or(turn = 0 AND text <> '') AS a FROM conversations GROUP BY conv_id) USING (conv_id)")
def sc03(spark, sf_dir):
    """Conversations as papers in JSON, odd ones with a list of records and even ones with a record of lists."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("section_name"), F.array("text", F.lit("end")).alias("paragraphs"))))
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"), F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("abstract"))
    title = F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title")
    records = F.to_json(F.struct(title, "abstract", F.transform("t", lambda x: F.struct(x["section_name"].alias("section_name"), x["paragraphs"].alias("paragraphs"))).alias("full_text")))
    arrays = F.to_json(F.struct(title, "abstract", F.struct(F.transform("t", lambda x: x["section_name"]).alias("section_name"), F.transform("t", lambda x: x["paragraphs"]).alias("paragraphs")).alias("full_text")))
    papers = m.select("conv_id", F.when(F.col("conv_id") % 2 == 1, records).otherwise(arrays).alias("json"))
    s = files.paper_sections(papers, "json", "conv_id")
    return s.select("conv_id", "section_index", "section_name", F.md5(F.array_join("paragraphs", "\n")).alias("text_md5"))


@query("sc04_csv_jsonl", "SELECT doc_id, md5(text) AS text_md5, 'csv' AS kind FROM documents UNION ALL SELECT doc_id, md5(text), 'jsonl' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, md5(text), 'jsonl' FROM documents WHERE doc_id % 3 = 0")
def sc04(spark, sf_dir):
    """Documents written as CSV with quotes and as JSON lines in two appends, and read back."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark, "rows")
    files.write_csv(docs, f"{folder}/csv")
    files.append_jsonl(docs.where("doc_id % 2 = 0"), f"{folder}/jsonl")
    files.append_jsonl(docs.where("doc_id % 3 = 0"), f"{folder}/jsonl")
    csv = files.read_csv(spark, f"{folder}/csv", "doc_id long, text string").withColumn("kind", F.lit("csv"))
    lines = spark.read.schema("doc_id long, text string").json(f"{folder}/jsonl").withColumn("kind", F.lit("jsonl"))
    return csv.unionByName(lines).select("doc_id", F.md5("text").alias("text_md5"), "kind")
