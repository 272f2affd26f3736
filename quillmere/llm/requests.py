"""The request texts of the project's tables, and how splits, sources and groups are written there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.canon import canonical
from quillmere.session import table

TABLES = (("handwritten_v0", "user_request"), ("agent_route_pairwise_v5", "query"))


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests of both tables: ``uid`` (row_id and table in one number), ``tbl`` (0 or 1) and ``text``."""
    parts = [
        table(spark, sf_dir, name).select((F.col("row_id") * 2 + i).alias("uid"), F.lit(i).alias("tbl"), F.col(text).cast("string").alias("text"))
        for i, (name, text) in enumerate(TABLES)
    ]
    return parts[0].unionAll(parts[1])


def table_name(uid: str) -> Column:
    """Name of the table of a uid."""
    return F.when(F.col(uid) % 2 == 0, TABLES[0][0]).otherwise(TABLES[1][0])


def row_id(uid: str) -> Column:
    return F.shiftright(uid, 1)


def plain_name(c: Column) -> Column:
    """Lower case, consistent characters, no outer space, one kind of separator."""
    return F.regexp_replace(F.trim(F.lower(canonical(c))), r"[\s_\-]+", "_")


def split_name(c: Column) -> Column:
    """train, val, test or unseen_test, however it is written; null for anything else."""
    name = plain_name(c)
    name = F.when(name.isin("valid", "validation", "dev"), "val").otherwise(name)
    return F.when(name.isin("train", "val", "test", "unseen_test"), name)


def group_number(c: Column) -> Column:
    """The number of a template group as digits without leading zeros; null if there is none."""
    digits = F.regexp_extract(canonical(c), r"([0-9]+)\s*$", 1)
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(short != "", short)
