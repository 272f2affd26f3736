"""The data tools: parameterised queries over documents, records and calendars.

Every function takes tables and parameters and returns a DataFrame; filters and projections reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of length in millimetres and of mass in grams.
UNITS = {"length": {"mm": 1, "cm": 10, "m": 1000, "km": 1000000}, "mass": {"g": 1, "kg": 1000, "t": 1000000}}


def search(docs: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """Documents that contain every token of the query, split at single spaces; a query without tokens finds nothing.  Case counts."""
    tokens = [t for t in query.split(" ") if t]
    text = F.concat_ws(" ", *fields)
    hit = F.lit(bool(tokens))
    for t in tokens:
        hit = hit & F.contains(text, F.lit(t))
    return docs.where(hit)


def search_many(docs: DataFrame, queries: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(query_id, query) x documents: one row per hit.  Equal queries are searched once.

    Each token list is tested with ``forall``; the queries of one call are a parameter, so they are the small side.
    """
    wanted = queries.withColumn("tokens", F.filter(F.split("query", " "), lambda t: t != "")).where(F.size("tokens") > 0)
    text = F.concat_ws(" ", *fields)
    return docs.withColumn("_text", text).join(wanted, F.forall("tokens", lambda t: F.contains(F.col("_text"), t))).drop("_text")


def lookup(requests: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each request with the record of its keys and a status ok or not_found."""
    found = records.withColumn("_found", F.lit(True))
    return requests.join(found, list(keys), "left").withColumn("status", F.when(F.col("_found"), "ok").otherwise("not_found")).drop("_found")


def half_up_mean(total: Column, n: Column, unit: int = 100) -> Column:
    """Mean of an integer total in units of 1/unit, rounded half up away from zero to that unit, as a double."""
    size = F.abs(total)
    rounded = F.floor((2 * size + n) / (2 * n))
    return (F.signum(total) * rounded / unit).cast("double")


def aggregate(records: DataFrame, metric: str, by: Sequence[str] = (), period: tuple[str, Column, Column] | None = None, isin: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """count, sum, mean, min and max of a two-place decimal metric, after filters that the scan can use.

    ``period`` is a closed range.  Without ``by`` there is one row in any case, with status no_data and null values if
    no row is left.  A null metric in a selected row is an error, as records must have the metric.
    """
    rows = records
    if period:
        name, low, high = period
        rows = rows.where((F.col(name) >= low) & (F.col(name) <= high))
    for name, values in (isin or {}).items():
        rows = rows.where(F.col(name).isin(*values))
    cents = F.round(F.col(metric).cast("decimal(20,2)") * 100).cast("bigint")
    checked = F.when(F.col(metric).isNotNull(), cents).otherwise(F.raise_error(F.lit(f"a record has no {metric}")).cast("bigint"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(checked).alias("s"), F.min(cents).alias("lo"), F.max(cents).alias("hi"))
    return sums.select(
        *by,
        F.when(F.col("n") == 0, "no_data").otherwise("ok").alias("status"),
        "n",
        (F.col("s") / 100).cast("double").alias("sum_value"),
        F.when(F.col("n") > 0, half_up_mean(F.col("s"), F.greatest("n", F.lit(1)))).alias("mean_value"),
        (F.col("lo") / 100).cast("double").alias("min_value"),
        (F.col("hi") / 100).cast("double").alias("max_value"),
    )


def convert(value: Column, source: str, target: str) -> Column:
    """A decimal value in another unit of the same family."""
    for family in UNITS.values():
        if source in family and target in family:
            return value.cast("decimal(18,4)") * F.lit(family[source]) / F.lit(family[target])
    raise ValueError(f"no conversion from {source} to {target}")


def next_id(ids: DataFrame, column: str, prefix: str, width: int = 4) -> DataFrame:
    """The identifier after the largest number that ids end in."""
    number = F.regexp_extract(column, r"([0-9]+)$", 1).try_cast("bigint")
    return ids.agg(F.concat(F.lit(prefix), F.lpad((F.coalesce(F.max(number), F.lit(0)) + 1).cast("string"), width, "0")).alias("next_id"))


#: Which tools each profile of a service offers.
PROFILES = {
    "all": ["search_documents", "get_record", "calculate", "aggregate_data", "check_availability", "create_event"],
    "query": ["search_documents", "get_record"],
    "calculate": ["calculate", "aggregate_data"],
    "calendar": ["check_availability", "create_event"],
}


def offered_tools(profile: Column, profiles: Mapping[str, Sequence[str]] = PROFILES) -> Column:
    """The tools of a profile as an array, by a map literal; null for a profile that there isn't."""
    known = F.create_map(*(x for k, v in profiles.items() for x in (F.lit(k), F.array(*(F.lit(t) for t in v)).cast("array<string>"))))
    return F.try_element_at(known, profile)


def contains_pairs(texts: DataFrame, text: str, needles: DataFrame, needle: str, most: int = 10_000, piece: int = 4) -> DataFrame:
    """Rows of ``texts`` with each row of ``needles`` whose needle stands in their text.

    Up to ``most`` needles are counted and sent to every task.  Beyond that texts and needles meet in pieces: a needle under
    its first characters, a text under each different run of as many characters, and the needle is verified; needles
    shorter than a piece are sent, and there may be ``most`` of them.
    """
    some = needles.where((F.col(needle).isNotNull()) & (F.col(needle) != ""))
    if some.limit(most + 1).count() <= most:
        return texts.join(F.broadcast(some), F.contains(F.col(text), F.col(needle)))
    short, long = some.where(F.length(needle) < piece), some.where(F.length(needle) >= piece)
    if short.limit(most + 1).count() > most:
        raise ValueError(f"over {most} needles of under {piece} characters")
    letters = F.sequence(F.lit(1), F.greatest(F.length(text) - piece + 1, F.lit(1)))
    runs = texts.where(F.col(text).isNotNull()).withColumn("_piece", F.explode(F.array_distinct(F.transform(letters, lambda i: F.substring(F.col(text), i, F.lit(piece))))))
    far = runs.join(long.withColumn("_piece", F.substring(F.col(needle), 1, piece)), "_piece").where(F.contains(F.col(text), F.col(needle))).drop("_piece")
    return far.unionByName(texts.join(F.broadcast(short), F.contains(F.col(text), F.col(needle))))
