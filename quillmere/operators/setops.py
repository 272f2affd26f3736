"""Set algebra and identity checks between tables, all as joins and aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.jsonvalue import strict_json


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side; empty if both have the same keys."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, list(keys), "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull()).select(*keys, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("only_in"))


def unseen(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't among those done: how an interrupted run goes on.  Null keys equal null keys."""
    d = done.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(d, same, "left_anti")


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values as often, in any order."""
    return F.array_sort(a) == F.array_sort(b)


#: Tokens of a JSON text without white space; an empty object is one token.
_TOKEN = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|\{\}|[{}\[\],:]|[^{}\[\],:"]++)'
_LEAF = "struct<path:string,value:string>"


def json_paths(doc: Column) -> Column:
    """(path, value) of every leaf of a JSON text, at any depth; none if it isn't valid JSON.

    A path is /key/key, with ~ and / in keys as ~0 and ~1; the path of a document that is no object is empty.  Values are
    JSON texts in one form, so "1" and 1 are different.  Arrays and empty objects are leaves.  One fold over the tokens:
    ``at`` is the path whose value comes next, null where a key comes next; ``open`` holds the objects around it.
    """
    tokens = F.regexp_extract_all(F.to_json(strict_json(doc)), F.lit(_TOKEN), F.lit(1))
    text = F.lit(None).cast("string")
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("deep"), F.lit("").alias("list"), F.array().cast(f"array<{_LEAF}>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        def state(at=s["at"], opened=s["open"], deep=s["deep"], held=s["list"], found=s["found"]) -> Column:
            return F.struct(at.alias("at"), opened.alias("open"), deep.alias("deep"), held.alias("list"), found.alias("found"))

        def leaf(value: Column) -> Column:
            return F.concat(s["found"], F.array(F.struct(s["at"].alias("path"), value.alias("value"))))

        deeper = s["deep"] + F.when(t.isin("[", "{"), 1).when(t.isin("]", "}"), -1).otherwise(0)
        longer = F.concat(s["list"], t)
        key = F.replace(F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        last = F.size(s["open"])
        return (
            F.when((s["deep"] > 0) & (deeper == 0), state(at=text, deep=F.lit(0), held=F.lit(""), found=leaf(longer)))
            .when(s["deep"] > 0, state(deep=deeper, held=longer))
            .when(t.isin(",", ":"), s)
            .when(s["at"].isNull() & (t == "}"), state(opened=F.slice(s["open"], F.lit(1), last - 1)))
            .when(s["at"].isNull(), state(at=F.concat(F.element_at(s["open"], -1), F.lit("/"), key)))
            .when(t == "[", state(deep=F.lit(1), held=t))
            .when(t == "{", state(at=text, opened=F.concat(s["open"], F.array(s["at"]))))
            .otherwise(state(at=text, found=leaf(t)))
        )

    return F.coalesce(F.aggregate(tokens, start, step, lambda s: s["found"]), F.array().cast(f"array<{_LEAF}>"))


def json_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], doc: str) -> DataFrame:
    """(keys, path, left, right) of every leaf that two JSON documents with the same keys don't have alike: full outer join of their paths."""

    def leaves(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, F.explode(json_paths(F.col(doc))).alias("leaf")).select(*keys, F.col("leaf.path").alias("path"), F.col("leaf.value").alias(side))

    both = leaves(left, "left").join(leaves(right, "right"), [*keys, "path"], "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))
