"""Near-duplicate requests (problem 1): tiles of bit sketches compared by exclusive-or and bit counts.

Each text's set of two-character pieces has a 128-bit parity sketch whose Hamming distance never exceeds
the number of pieces that differ.  Tiles of sketches are compared exactly, and two tiles are skipped if
the counts of their sets already differ beyond the radius.  All tiles against all others would grow
with the square of the table, so tiles are formed within buckets: every text stands in the buckets of
its rarest pieces, as many as a prefix filter needs to lose no pair, and pairs that pass are verified on
the whole texts.  No step is approximate.

Defined results: null, empty and blank texts are in no pair; a text of one character equals only its
copies; equal rows are one class and are compared once; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.canon import canonical_dense
from quillmere.llm.grams import Commonness, hashed_bigrams
from quillmere.llm.neartext import RARE_PIECE, SIMILARITY, hashed_classes, near_classes, representatives


def near_duplicates(rows: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(uid, tbl, text) -> pairs (a, b) of classes of one table that are nearly the same, and members (rep, uid)."""
    common = Commonness.fit(rows, "text", hashed_bigrams, RARE_PIECE)
    hashed = hashed_classes(rows, canonical_dense(F.col("text")), ["tbl"])
    reps = representatives(hashed, F.first("tbl").alias("tbl"))
    # the table is the side, so only texts of one table meet
    pairs = near_classes(rows, reps.withColumn("side", F.col("tbl")), common, least)
    members = hashed.join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "uid")
    return pairs, members


def row_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of rows (row_a, row_b) of one class or of two near classes."""
    a = members.select(F.col("rep").alias("a"), F.col("uid").alias("ua"))
    b = members.select(F.col("rep").alias("b"), F.col("uid").alias("ub"))
    across = pairs.join(a, "a").join(b, "b").select("ua", "ub")
    within = a.join(b, F.col("a") == F.col("b")).where("ua < ub").select("ua", "ub")
    return across.unionAll(within).select(F.least("ua", "ub").alias("ua"), F.greatest("ua", "ub").alias("ub"))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per row: its class, copies in the class, and links of the class to other classes."""
    ends = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    return members.join(copies, "rep").join(ends, "rep", "left").select("uid", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
