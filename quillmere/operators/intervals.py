"""Joins of half-open intervals that overlap, through time buckets instead of a cross product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(c: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(c.cast("timestamp")) / seconds)


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], seconds: int = 21600) -> DataFrame:
    """Pairs of intervals [l_start, l_end) and [r_start, r_end) with equal keys that overlap.

    Each interval is put in every bucket it touches and pairs meet in buckets; a pair is kept only in the bucket in
    which the later of its starts lies, so none comes twice and nothing needs to be made distinct.  A bucket should be
    about as long as the intervals; empty intervals overlap nothing.
    """

    def spread(df: DataFrame, side: str) -> DataFrame:
        start, end = F.col(f"{side}_start"), F.col(f"{side}_end")
        solid = df.where(start < end)
        last = F.floor((F.unix_timestamp(end.cast("timestamp")) - 1) / seconds)
        return solid.withColumn("_bucket", F.explode(F.sequence(_bucket(start, seconds), F.greatest(last, _bucket(start, seconds)))))

    joined = spread(left, "l").join(spread(right, "r"), [*keys, "_bucket"])
    meet = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    return joined.where(meet & (F.col("_bucket") == _bucket(F.greatest("l_start", "r_start"), seconds))).drop("_bucket")
