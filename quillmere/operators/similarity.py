"""Exact similarity joins on sets of two-character pieces: prefix filter, size filter, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.functions.text import bigrams, jaccard, shape, strip_space


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The texts with a piece, without white space."""
    return df.select(F.col(key).alias("id"), strip_space(F.col(text)).alias("text")).where(F.length("text") > 1)


def _classes(texts: DataFrame) -> DataFrame:
    """Texts that are equal without white space are joined once, under their smallest id, and expanded later."""
    return texts.groupBy("text").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("members"))


def _members(texts: DataFrame, as_class: str, as_id: str) -> DataFrame:
    return texts.join(_classes(texts), "text").select(F.col("class").alias(as_class), F.col("id").alias(as_id))


#: Rows of one piece that may meet in one task; a commoner piece's rows are dealt out to cells of about this size.
CELL = 20_000


def _prefixes(sets: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """The pieces of each set under which the fewest pairs meet, so many that two sets with similarity ``least`` share one of them, with the piece's cells."""
    n = F.size("grams")
    exact = F.lit(least).cast("decimal(6,4)")
    each = sets.select("id", n.alias("n"), (n - F.ceil(n * exact) + 1).alias("keep"), F.explode("grams").alias("gram"))
    ranked = each.join(frequency, "gram").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("meets", "gram")))
    # a piece of one side only has its place, but nothing meets there
    return ranked.where((F.col("place") <= F.col("keep")) & (F.col("meets") > 0)).select("id", "gram", "n", "place", F.ceil(F.col("df") / CELL).cast("int").alias("cells"))


def _near(a: DataFrame, b: DataFrame, within: bool, least: float, most_apart: int | None) -> DataFrame:
    """(a, b, similarity) of sets; ``within``: of one side with itself, a < b."""
    here, there = F.lit(1).cast("long"), F.lit(0).cast("long")
    each = a.select(F.explode("grams").alias("gram"), here.alias("l"), (here if within else there).alias("r"))
    if not within:
        each = each.unionAll(b.select(F.explode("grams"), there, here))
    frequency = each.groupBy("gram").agg((F.sum("l") * F.sum("r")).alias("meets"), F.greatest(F.sum("l"), F.sum("r")).alias("df"))
    pa = _prefixes(a, frequency, least).select("gram", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("ia"), F.pmod(F.hash("id"), F.col("cells")).alias("cell"))
    pb = _prefixes(b, frequency, least).select("gram", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("ib"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    # at their first common piece two sets share it and what is left of the shorter rest, at most; this covers the sizes as well
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1
    fits = most * (1 + least) >= (F.col("na") + F.col("nb")) * least - 1e-6
    if within:
        fits = fits & (F.col("a") < F.col("b"))
    if most_apart is not None:
        fits = fits & (F.abs(F.col("na") - F.col("nb")) <= most_apart)
    pairs = pa.join(pb, ["gram", "cell"]).where(fits).select("a", "b").distinct()
    with_sets = pairs.join(a.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(b.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    return with_sets.select("a", "b", jaccard(F.col("ga"), F.col("gb")).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def similar_pairs(left: DataFrame, right: DataFrame | None, key: str, text: str, least: float, most_apart: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs with similarity ``least`` or more; without ``right`` pairs within ``left``, a < b.

    Lossless: two such sets share one of their first ``n - ceil(least * n) + 1`` pieces under any common order, and at
    the first piece that they share enough is left of both.  Pieces go by the number of pairs that meet under them, so
    one that only one side has comes first and lets none meet.
    ``most_apart`` leaves out pairs whose set sizes differ by more, as a leakage audit may define.  A left row stands in
    one cell of each of its pieces, a right row in all of them, so no task holds all rows of a common piece.
    """
    within = right is None
    texts = _texts(left, key, text)
    others = texts if within else _texts(right, key, text)
    a = _classes(texts).select(F.col("class").alias("id"), bigrams(F.col("text")).alias("grams"))
    b = a if within else _classes(others).select(F.col("class").alias("id"), bigrams(F.col("text")).alias("grams"))
    near = _near(a, b, within, least, most_apart)
    if within:
        near = near.unionAll(_classes(texts).where("members > 1").select("class", "class", F.lit(1.0)))
    every = near.join(_members(texts, "a", "x"), "a").join(_members(others, "b", "y"), "b")
    if within:
        every = every.where("a < b or x < y").withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")})
    return every.select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity")


def shape_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class, members): texts whose normalized characters are the same in some order; the class is the smallest id."""
    made = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.sha2(shape(F.col(text)), 256).alias("shape"))
    classes = made.groupBy("shape").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("members"))
    return made.join(classes, "shape").select("id", "class", "members")
