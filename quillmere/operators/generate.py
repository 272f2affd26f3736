"""Samples from templates: groups times phrasings, rotations, products of parts, augmentation, label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.text import space_edges


def expand_groups(groups: DataFrame) -> DataFrame:
    """One sample for each phrasing of a group; the n-th takes the n-th question, around again after the last."""
    each = groups.select("id", "category", "questions", F.posexplode("phrasings").alias("place", "phrasing"))
    question = F.when(F.size("questions") > 0, F.element_at("questions", (F.col("place") % F.greatest(F.size("questions"), F.lit(1)) + 1).cast("int")))
    return each.select("id", "category", "place", space_edges(F.col("phrasing")).alias("request"), question.alias("question"))


def product(*parts: DataFrame) -> DataFrame:
    """Every combination of a few short lists of template parts; the lists are parameters, not tables of data."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def doubled(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Each row twice, the second time with a prefix before its text."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.explode(F.array(F.col(text), F.concat(F.lit(prefix), F.col(text)))).alias(text))


def response_labels(prompt: Column, answer: Column, longest: int) -> Column:
    """Labels of a training sequence: -100 for each prompt token, then the answer's ids; an error if it is too long."""
    whole = F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), answer)
    return F.when(F.size(whole) <= longest, whole).otherwise(F.raise_error(F.lit("sequence too long")).cast("array<int>"))
