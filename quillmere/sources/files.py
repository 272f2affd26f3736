"""Sources and sinks: JSON documents and lines, guarded writes, Markdown, file digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmere.functions.jsonvalue import strict_json


def read_document(spark: SparkSession, path: str, schema: StructType | str, field: str) -> DataFrame:
    """The rows of an array in a JSON document that is one value over many lines."""
    return spark.read.schema(f"`{field}` array<struct<{schema}>>" if isinstance(schema, str) else schema).option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def read_tolerant(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, value, code): each file's JSON as VARIANT, or FILE_MISSING or JSON_SYNTAX."""
    wanted = spark.createDataFrame([(p,) for p in paths], "path string")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p))]
    if there:
        texts = spark.read.text(there, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), "value")
    else:
        texts = spark.createDataFrame([], "path string, value string")
    read = texts.select("path", strict_json(F.col("value")).alias("value"), F.lit(True).alias("found"))
    code = F.when(F.col("found").isNull(), "FILE_MISSING").when(F.col("value").isNull(), "JSON_SYNTAX")
    return wanted.join(read, "path", "left").select("path", "value", code.alias("code"))


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines."""
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; without ``append`` an existing target is an error, so nothing is overwritten."""
    df.write.mode("append" if append else "errorifexists").json(path)


def write_documents(df: DataFrame, path: str, by: str, order: Sequence[str], field: str) -> None:
    """One readable JSON document for each value of ``by``: ``{"field": [...]}``, rows in the order of ``order``, keys of a row in order of name, nulls named.

    A document is one file below ``of_by=value``, so one task writes it, line by line from a sort that spills; documents are
    for small and middling parts, ``write_lines`` for large ones.  An existing target is an error.
    """

    def text(c: str) -> Column:
        whole = F.to_json(F.struct(F.col(c).alias("v")))
        return F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))

    row = F.concat(F.lit("    {"), F.concat_ws(", ", *(F.concat(F.lit(f'"{c}": '), text(c)) for c in sorted(df.columns))), F.lit("}"))
    key = F.struct(*order)
    ends = df.groupBy(F.col(by).alias("_by")).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    made = df.withColumn("_key", key).withColumn("_row", row).join(ends, F.col(by).eqNullSafe(F.col("_by")), "left")
    line = F.concat(F.when(F.col("_key") == F.col("_first"), F.lit(f'{{\n  "{field}": [\n')).otherwise(F.lit("")), F.col("_row"), F.when(F.col("_key") == F.col("_last"), F.lit("\n  ]\n}")).otherwise(F.lit(",")))
    made.select(F.coalesce(F.col(by).cast("string"), F.lit("null")).alias(f"of_{by}"), "_key", line.alias("value")).repartition(F.col(f"of_{by}")).sortWithinPartitions(f"of_{by}", "_key").drop("_key").write.partitionBy(f"of_{by}").mode("errorifexists").text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One line of a Markdown table for each row; bars inside values become full-width."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "｜") for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, each read as a whole, so lines keep their order."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
