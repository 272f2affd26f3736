"""Rows whose texts look the same but aren't the same string (problem 6).

Defined results: null, empty and blank texts are in no pair; equal strings are no pair; an empty table
gives no rows.  Rows are brought together by 128 bits of the consistent form; only forms written in more
than one way are joined with themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.canon import canonical
from quillmere.session import settle


def _mixed(rows: DataFrame) -> DataFrame:
    """(h1, h2, uid, raw): rows of the forms that are written in more than one way, with a hash of the string."""
    formed = rows.where(F.col("text") != "").withColumn("form", canonical(F.col("text"))).where(F.col("form").rlike(r"(?U)\S"))
    hashed = settle(formed.select("uid", F.xxhash64("tbl", "form").alias("h1"), F.xxhash64(F.lit(7), "tbl", "form").alias("h2"), F.xxhash64("text").alias("raw")), "forms")
    mixed = hashed.groupBy("h1", "h2").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("h1", "h2")
    return hashed.join(mixed, ["h1", "h2"])


def look_alike_groups(rows: DataFrame) -> DataFrame:
    """(uid, tbl, text) -> (uid, class, members, spellings): a row for each row whose text is written in another way elsewhere in its
    table; the class is the smallest uid that looks so.  Its size follows the rows, however many pairs a class would give."""
    some = settle(_mixed(rows), "mixed")
    classes = some.groupBy("h1", "h2", "raw").agg(F.min("uid").alias("low"), F.count(F.lit(1)).alias("n")).groupBy("h1", "h2").agg(F.min("low").alias("class"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("spellings"))
    return some.join(classes, ["h1", "h2"]).select("uid", "class", "members", "spellings")


def look_alike_pairs(rows: DataFrame) -> DataFrame:
    """(uid, tbl, text) -> pairs (ua, ub), ua < ub, of rows of one table that look the same and differ as strings; all of them by
    definition, so a hot class gives its square (``look_alike_groups`` doesn't)."""
    some = _mixed(rows)
    a = some.select("h1", "h2", F.col("uid").alias("ua"), F.col("raw").alias("ra"))
    b = some.select("h1", "h2", F.col("uid").alias("ub"), F.col("raw").alias("rb"))
    return a.join(b, ["h1", "h2"]).where("ua < ub and ra <> rb").select("ua", "ub")
