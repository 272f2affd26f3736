"""Queries that go through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.text import split_name
from quillmere.plans.contracts import split_sql
from quillmere.session import scratch, table
from quillmere.sources.files import file_digests, markdown_rows, read_document, read_lines, write_documents, write_lines
from quillmere.streaming.resume import append_new


def io_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Results through JSON lines and back, every nested value kept."""
    path = scratch(spark, "lines")
    rows = table(spark, sf, "route_rows").select("row_id", "case_id", "routes", "calls", "latency_ms", "correct")
    write_lines(rows, path)
    back = read_lines(spark, path, rows.schema)
    return back.groupBy("correct").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("routes")).alias("routes"), F.max("latency_ms").alias("latency"), F.count("case_id").alias("cases"))


def io_resumable_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping appends to a log: each key is in it once."""
    path = scratch(spark, "log")
    rows = table(spark, sf, "agent_route_pairwise_v5").select("row_id", "id", "query")
    append_new(rows.where("row_id % 3 <> 0"), path, ["row_id"])
    append_new(rows, path, ["row_id"])
    return spark.read.schema(rows.schema).json(path).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))


def io_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return markdown_rows(table(spark, sf, "documents").select("doc_id", "title", "source"), ["doc_id", "title", "source"])


def io_file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of the data folder."""
    return file_digests(spark, f"{sf}/*.parquet").select("bytes", "sha256")


def io_json_document(spark: SparkSession, sf: str) -> DataFrame:
    """Template groups as one readable JSON document for each split, with keys in order, and read back as rows."""
    path = scratch(spark, "document")
    rows = table(spark, sf, "groups_clarify").select("row_id", "id", "category", "tags", split_name(F.col("split")).alias("split"))
    write_documents(rows, path, "split", ["row_id"], "samples")
    back = read_document(spark, path, "category string, id string, row_id long, split string, tags array<string>", "samples")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("rows"), F.sum(F.size("tags")).alias("tags"), F.min("id").alias("first_id"))


SQL = {
    "io_json_document": f"select {split_sql('split')} as split, count(*) as n, cast(sum(row_id) as bigint) as rows, cast(sum(len(tags)) as bigint) as tags, min(id) as first_id from groups_clarify group by 1",
    "io_json_lines": "select correct, count(*) as n, cast(sum(len(routes)) as bigint) as routes, max(latency_ms) as latency, count(case_id) as cases from route_rows group by 1",
    "io_resumable_append": "select row_id, cast(1 as bigint) as n from agent_route_pairwise_v5",
    "io_markdown": "select '| ' || doc_id || ' | ' || replace(coalesce(title, ''), '|', '｜') || ' | ' || replace(coalesce(source, ''), '|', '｜') || ' |' as line from documents",
}
QUERIES = {f.__name__: f for f in (io_json_lines, io_resumable_append, io_markdown, io_file_digests, io_json_document)}
