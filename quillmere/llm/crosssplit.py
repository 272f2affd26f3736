"""The same or nearly the same records in different splits (problem 5): blocks of a similarity-hash code.

Each text has a code of bits: 128 parity bits of its two-character pieces, of which similar texts share most, and one
block of hashed bits for each of its rarest pieces.  Codes are joined across splits where one block is equal, only
between the training and the evaluation side; the parity bits must lie within the Hamming radius of the wanted
similarity; then the texts are verified, and overlaps are counted by split and source.  A code has so many blocks that
similar texts must share one (see ``neartext.rare_pieces``), so no overlap is lost.

Bits of random projections, cut into segments, can't do that: at a similarity of 0.75 one bit in six differs, so of a
64-bit code no segment that is long enough to be selective stays equal.

Defined results: null, empty and blank texts and null or unknown splits are in no overlap; the same text on
both sides overlaps; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.canon import canonical_dense
from quillmere.llm.grams import Commonness, hashed_bigrams
from quillmere.llm.neartext import RARE_PIECE, SIMILARITY, hashed_classes, near_classes, representatives

def cross_split(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(uid, side, text), side 1 for training and 2 for evaluation -> pairs (ua, ub) of rows of either side that are nearly the same."""
    rows = rows.where("side in (1, 2)")
    common = Commonness.fit(rows, "text", hashed_bigrams, RARE_PIECE)
    hashed = hashed_classes(rows, canonical_dense(F.col("text")), [], ["side"])
    reps = representatives(hashed, F.bit_or("side").alias("side"))
    pairs = near_classes(rows, reps, common, least, crossing=True)
    members = hashed.join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "uid", F.col("side").alias("of"))
    a = members.select(F.col("rep").alias("a"), F.col("uid").alias("ua"), F.col("of").alias("sa"))
    b = members.select(F.col("rep").alias("b"), F.col("uid").alias("ub"), F.col("of").alias("sb"))
    across = pairs.join(a, "a").join(b, "b").where("sa <> sb").select("ua", "ub", "sa")
    within = a.where("sa = 1").join(b.where("sb = 2"), F.col("a") == F.col("b")).select("ua", "ub", "sa")
    return across.unionAll(within).select(F.when(F.col("sa") == 1, F.col("ua")).otherwise(F.col("ub")).alias("train_uid"), F.when(F.col("sa") == 1, F.col("ub")).otherwise(F.col("ua")).alias("eval_uid"))
