"""Dataset audits: digests of tables, leaked names, review logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType, TimestampNTZType, TimestampType


#: What stands for null, between fields and between members in the text of a row.
NULL, FIELD, MEMBER = "\x1e", "\x1f", "\x1d"


def canonical_column(c: Column, kind: DataType) -> Column:
    """One text for each value of a column of any type: doubles in millionths, moments in microseconds, arrays and structs member by member."""
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        text = F.unix_micros(c.cast("timestamp")).cast("string")
    elif isinstance(kind, (DoubleType, FloatType)):
        text = F.floor(c.cast("double") * 1000000 + 0.5).cast("string")
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_column(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, StructType):
        text = F.when(c.isNotNull(), F.concat_ws(MEMBER, *(canonical_column(c[f.name], f.dataType) for f in kind.fields)))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL))


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The first 60 bits of the SHA-256 of a row's columns, in order of name unless they are given, as a decimal number."""
    types = {f.name: f.dataType for f in df.schema.fields}
    row = F.sha2(F.concat_ws(FIELD, *(canonical_column(F.col(c), types[c]) for c in columns or sorted(types))), 256)
    return F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")


def table_digest(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows and a digest that doesn't depend on their order: the sum of the rows' digests, of all columns unless some are given; by group if asked."""
    made = df.select(*by, row_digest(df, columns).alias("_d")).groupBy(*by)
    return made.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_d"), F.lit(0)).cast("string").alias("digest"))


def leaks(text: Column, names: Sequence[str]) -> Column:
    """The forbidden names that a text contains."""
    return F.filter(F.array(*(F.lit(x) for x in names)), lambda x: F.contains(text, x))


def review_log(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) of a Markdown log -> (section, id, checked): check boxes below their headings."""
    header = F.when(F.startswith("line", F.lit("## ")), F.trim(F.substr("line", F.lit(4))))
    below = lines.withColumn("section", F.last(header, True).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    pattern = r"^- \[([ xX])\] (\S+)"
    return below.where(F.col("line").rlike(pattern)).select("section", F.regexp_extract("line", pattern, 2).alias("id"), (F.lower(F.regexp_extract("line", pattern, 1)) == "x").alias("checked"))


def review_closure(sampled: DataFrame, log: DataFrame) -> DataFrame:
    """What a review still owes: sampled and not in the log, unchecked, or in the log and never sampled."""
    s = sampled.select("id").distinct().withColumn("_s", F.lit(1))
    seen = log.groupBy("id").agg(F.max("checked").alias("checked"))
    state = F.when(F.col("_s").isNull(), "PHANTOM").when(F.col("checked").isNull(), "MISSING").when(~F.col("checked"), "UNCHECKED")
    return s.join(seen, "id", "full_outer").select("id", state.alias("code")).where("code is not null")


def review_faults(lines: DataFrame, sampled: DataFrame, wanted: int, findings: str) -> DataFrame:
    """(id, code) of a review log (file, line_no, line): what ``review_closure`` finds, SHORT where a section has fewer checked boxes than
    wanted (or all of its sample, if that is smaller), FINDINGS_EMPTY where the section of findings says nothing.  ``sampled``: section, id."""
    header = F.when(F.startswith("line", F.lit("## ")), F.trim(F.substr("line", F.lit(4))))
    below = lines.withColumn("section", F.last(header, True).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    said = below.where((F.col("section") == findings) & ~F.startswith("line", F.lit("## ")) & (F.trim("line") != "")).agg(F.count(F.lit(1)).alias("n"))
    log = review_log(lines)
    checked = log.where("checked").groupBy("section").agg(F.countDistinct("id").alias("done"))
    asked = sampled.groupBy("section").agg(F.countDistinct("id").alias("asked"))
    short = asked.join(checked, "section", "left").where(F.coalesce("done", F.lit(0)) < F.least(F.lit(wanted), "asked")).select(F.col("section").alias("id"), F.lit("SHORT").alias("code"))
    return review_closure(sampled, log).unionAll(short).unionAll(said.where("n = 0").select(F.lit(findings).alias("id"), F.lit("FINDINGS_EMPTY").alias("code")))


def projection_codes(text: Column, request: Column, forbidden: Sequence[str], secrets: Column, answer: Column) -> Column:
    """Codes of a rendered input: GOLD_LEAK if it names a forbidden key or one of its case's secrets (an array), GOLD_ANSWER_LEAK if it
    has the gold answer, REQUEST_MISSING if it lacks the request."""
    leak = F.size(leaks(text, forbidden)) > 0
    secret = F.exists(F.array_compact(secrets), lambda x: (x != "") & F.contains(text, x))
    rules = [(leak | secret, "GOLD_LEAK"), ((answer != "") & F.contains(text, answer), "GOLD_ANSWER_LEAK"), (~F.contains(text, request), "REQUEST_MISSING")]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for bad, code in rules)))


def manifest_check(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(name, code) of tables whose rows or digest (name, n, digest) are no longer those frozen, that are gone, or that were never frozen."""
    f = frozen.select("name", F.struct("n", "digest").alias("_frozen"))
    both = f.join(now.select("name", F.struct("n", "digest").alias("_now")), "name", "full_outer")
    code = F.when(F.col("_now").isNull(), "FROZEN_MISSING").when(F.col("_frozen").isNull(), "NOT_FROZEN").when(~F.col("_frozen").eqNullSafe(F.col("_now")), "FROZEN_DRIFT")
    return both.select("name", code.alias("code")).where("code is not null")


def freeze(now: DataFrame, errors: DataFrame, path: str) -> None:
    """Write a manifest (name, n, digest); an error that is pending, or a manifest that stands there, keeps it from being written."""
    if not errors.isEmpty():
        raise ValueError("not frozen: errors are pending")
    now.select("name", "n", "digest").coalesce(1).write.mode("errorifexists").json(path)


def input_drift(stored: DataFrame, rendered: DataFrame) -> DataFrame:
    """(id, code) where a stored input (id, input) isn't what its sample renders to now, or only one side has the id."""
    s = stored.select("id", F.struct("input").alias("_stored"))
    both = s.join(rendered.select("id", F.struct("input").alias("_now")), "id", "full_outer")
    code = F.when(F.col("_stored").isNull(), "INPUT_MISSING").when(F.col("_now").isNull(), "INPUT_ID_DRIFT").when(~F.col("_stored").eqNullSafe(F.col("_now")), "INPUT_DRIFT")
    return both.select("id", code.alias("code")).where("code is not null")
