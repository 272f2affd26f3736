"""Append-only results that an interrupted run resumes: a stream that keeps the first of equal keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from quillmere.operators.setops import unseen
from quillmere.session import scratch


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Process what a stream has now into a Parquet sink with a checkpoint, both in the shared folder, and read it."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def first_of_each(stream: DataFrame, keys: Sequence[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key of a stream.  With an event time and how late rows may come, keys are forgotten behind the
    watermark, so state is bounded and a repetition later than that comes out again; without them all keys are state."""
    if time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def same_configuration(spark: SparkSession, path: str, settings: Mapping[str, str]) -> None:
    """Note the settings of a run beside its log, or raise if the log was begun with others."""
    wanted = {k: str(v) for k, v in settings.items()}
    try:
        noted = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{path}/settings").collect()}
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        spark.createDataFrame(sorted(wanted.items()), "name string, value string").coalesce(1).write.json(f"{path}/settings")
        return
    if noted != wanted:
        raise ValueError(f"the log was begun with other settings: {sorted(k for k in noted.keys() | wanted.keys() if noted.get(k) != wanted.get(k))}")


def append_new(rows: DataFrame, path: str, keys: Sequence[str], settings: Mapping[str, str] | None = None) -> None:
    """Append the rows whose keys the log at ``path`` doesn't have, in JSON lines; calling it again adds nothing.  A log with
    ``settings`` goes on with the same ones only; they stand beside it (``path``.run)."""
    spark = rows.sparkSession
    if settings is not None:
        same_configuration(spark, f"{path}.run", settings)
    try:
        done = spark.read.schema(rows.schema).json(path)
        rows = unseen(rows, done, keys)
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    rows.write.mode("append").json(path)
