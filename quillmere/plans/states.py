"""Queries of stateful operators: resumed logs, pending confirmations, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.session import table, table_stream
from quillmere.streaming.pending import confirmations, confirmations_stream
from quillmere.streaming.resume import run_once

def _kind() -> Column:
    return F.when(F.col("event_type") == "view", "issue").when(F.col("event_type") == "purchase", "confirm").alias("kind")


def st1_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Results as a stream, one row for each case, version and day."""
    stream = table_stream(spark, sf, "route_rows")
    return run_once(stream.select("case_id", "adapter_version", "run_day").dropDuplicates(), "dedup")


def st2_pending_confirm(spark: SparkSession, sf: str) -> DataFrame:
    return confirmations(table(spark, sf, "events").select("user_id", "event_id", "ts", _kind()).where("kind is not null"))


def st2_pending_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = table_stream(spark, sf, "events")
    return run_once(confirmations_stream(stream.select("user_id", "event_id", "ts", _kind()).where("kind is not null")), "pending")


def st3_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events before and after a moment: which kinds came and which went."""
    moment = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    kinds = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("ts") < moment, F.col("event_type"))).alias("before"), F.collect_set(F.when(F.col("ts") >= moment, F.col("event_type"))).alias("after"))
    return kinds.select("user_id", F.array_join(F.array_sort(F.array_except("after", "before")), ",").alias("came"), F.array_join(F.array_sort(F.array_except("before", "after")), ",").alias("went"))


_CONFIRM = "with e as (select user_id, event_id, ts, case event_type when 'view' then 'issue' else 'confirm' end as kind from events where event_type in ('view', 'purchase')), t as (select *, last_value(case when kind = 'issue' then event_id end ignore nulls) over w as token, last_value(case when kind = 'issue' then ts end ignore nulls) over w as issued from e window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)), s as (select user_id, event_id as confirm_id, ts, token, case when token is null then 'unknown' when date_diff('microsecond', issued, ts) > 600000000 then 'expired' else 'in_time' end as state from t where kind = 'confirm') select user_id, confirm_id, token, case when state <> 'in_time' then state when row_number() over (partition by user_id, token, state order by ts, confirm_id) = 1 then 'confirmed' else 'replayed' end as outcome from s"
SQL = {
    "st1_stream_dedup": "select distinct case_id, adapter_version, run_day from route_rows",
    "st2_pending_confirm": _CONFIRM,
    "st2_pending_stream": _CONFIRM,
    "st3_snapshot_diff": "with k as (select user_id, list_distinct(list(event_type) filter (ts < timestamp '2024-01-16')) as b, list_distinct(list(event_type) filter (ts >= timestamp '2024-01-16')) as a from events group by 1) select user_id, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: not list_contains(coalesce(b, []), x))), ',') as came, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: not list_contains(coalesce(a, []), x))), ',') as went from k",
}
QUERIES = {f.__name__: f for f in (st1_stream_dedup, st2_pending_confirm, st2_pending_stream, st3_snapshot_diff)}
