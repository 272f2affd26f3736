"""Grouped metrics over results: grouping sets, rates with half-even rounding, integer means, exact percentiles by ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.session import settle


def rate(hits: Column, of: Column, places: int = 4) -> Column:
    """hits / of, rounded half to even; null if there is nothing to divide by."""
    return F.bround(F.try_divide(hits, of), places)


def thousandths_mean(value: Column) -> Column:
    """Mean of values with three places, as an integer of thousandths rounded half up: it doesn't depend on the order of rows."""
    units = F.round(value * 1000).cast("bigint")
    n = F.count(value)
    return F.when(n > 0, F.floor((2 * F.sum(units) + n) / (2 * F.greatest(n, F.lit(1)))).cast("bigint"))


def summary_sets(df: DataFrame, sets: Sequence[Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """Measures over several groupings in one aggregation; columns outside a grouping are null, ``level`` numbers the grouping."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id().alias("level"), *measures)


def ranked_percentiles(df: DataFrame, keys: Sequence[str], value: str, tie: str, shares: Sequence[float]) -> DataFrame:
    """(keys, n, at): exact percentiles with linear interpolation over all rows of each group whose value isn't null.

    The rows are sorted once over all tasks, ties broken by ``tie``; a rank is a place within its task plus the rows of the
    group in the tasks before, so no task holds a group, however hot.  The sorted rows are written, since a second sort
    might cut them elsewhere.
    """
    from pyspark.sql.types import DoubleType

    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*named, F.col(value).cast(DoubleType()).alias("_v"), F.col(tie).alias("_t"))
    parted = settle(rows.repartitionByRange(*ks, "_v", "_t").withColumn("_part", F.spark_partition_id()), "sorted")
    counts = parted.groupBy(*ks, "_part").agg(F.count(F.lit(1)).alias("_here"))  # a row for each group and task
    offsets = counts.select(*ks, "_part", (F.sum("_here").over(W.partitionBy(*ks).orderBy("_part")) - F.col("_here")).alias("_before"), F.sum("_here").over(W.partitionBy(*ks)).alias("n"))
    same = (F.col("o._part") == F.col("r._part"))
    for k in ks:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}"))
    placed = parted.withColumn("_place", F.row_number().over(W.partitionBy("_part", *ks).orderBy("_v", "_t"))).alias("r").join(offsets.alias("o"), same)
    rank = F.col("_before") + F.col("_place") - 1
    spots = [(F.col("n") - 1) * F.lit(q) for q in shares]
    wanted = F.lit(False)
    for spot in spots:
        wanted = wanted | (rank == F.floor(spot)) | (rank == F.ceil(spot))
    few = placed.select(*(F.col(f"r.{k}").alias(k) for k in ks), "n", "_v", rank.alias("_rank")).where(wanted)
    ends = [(F.max(F.when(F.col("_rank") == F.floor(spot), F.col("_v"))), F.max(F.when(F.col("_rank") == F.ceil(spot), F.col("_v"))), spot - F.floor(spot)) for spot in spots]
    made = few.groupBy(*ks, "n").agg(*(c.alias(f"{e}{i}") for i, (lo, hi, _) in enumerate(ends) for e, c in (("lo", lo), ("hi", hi))))
    at = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part for i, (_, _, part) in enumerate(ends)]
    return made.select(*(F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)), "n", F.array(*at).alias("at"))
