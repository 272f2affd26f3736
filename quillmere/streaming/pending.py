"""Writes that wait for a confirmation: issued tokens, a time limit, one use each.  Batch and streaming forms agree.

The limit counts in event time, so replays give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: seconds in which a token can be confirmed.
LIMIT = 600
#: Seconds after its issue for which a token is known to a stream with a watermark.
KEPT = 86400
OUTCOMES = "user_id long, confirm_id long, token long, outcome string"


def confirmations(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(user_id, event_id, ts, kind) with kind issue or confirm -> the outcome of each confirm.

    A confirm refers to the user's latest token: confirmed, expired after the limit, replayed if it was used before,
    unknown without a token.  With a column ``allowed``, what the gate says of the write at the moment of the confirm, a
    confirm in time that isn't allowed (null included) is rejected, and the token is used up all the same.
    """
    allowed = F.coalesce(F.col("allowed"), F.lit(False)) if "allowed" in events.columns else F.lit(True)
    events = events.withColumn("allowed", allowed)
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    token = F.last(F.when(F.col("kind") == "issue", F.struct(F.col("event_id").alias("id"), F.col("ts").alias("at"))), True).over(order)
    asked = events.withColumn("token", token).where("kind = 'confirm'")
    late = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("token.at").cast("timestamp")) > limit * 1000000
    judged = asked.select("user_id", F.col("event_id").alias("confirm_id"), "ts", "allowed", F.col("token.id").alias("token"), F.when(F.col("token").isNull(), "unknown").when(late, "expired").otherwise("in_time").alias("state"))
    first = F.row_number().over(W.partitionBy("user_id", "token", "state").orderBy("ts", "confirm_id"))
    outcome = F.when(F.col("state") != "in_time", F.col("state")).when(first > 1, "replayed").when(F.col("allowed"), "confirmed").otherwise("rejected")
    return judged.select("user_id", "confirm_id", "token", outcome.alias("outcome"))


def _advancing(limit: int):
    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        token, at, used = state.get if state.exists else (None, None, False)
        none = pd.DataFrame([], columns=["user_id", "confirm_id", "token", "outcome"]).astype({"token": "Int64"})
        if state.hasTimedOut:
            # past the limit a token can only expire; its number and moment are all that a late confirm needs
            state.remove()
            yield none
            return
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])  # one user's events of one micro-batch
        out = []
        for event, us, kind, allowed in rows[["event_id", "us", "kind", "allowed"]].itertuples(index=False):
            if kind == "issue":
                token, at, used = int(event), int(us), False
            elif token is None:
                out.append((key[0], int(event), None, "unknown"))
            elif us - at > limit * 1000000:
                out.append((key[0], int(event), token, "expired"))
            else:
                out.append((key[0], int(event), token, "replayed" if used else "confirmed" if allowed else "rejected"))
                used = True
        if token is not None:
            state.update((token, at, used))
            if timed(state):
                state.setTimeoutTimestamp(max(at // 1000 + KEPT * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=none.columns).astype({"token": "Int64"}) if out else none

    def timed(state: GroupState) -> bool:
        return state._timeout_conf == GroupStateTimeout.EventTimeTimeout

    return advance


def confirmations_stream(events: DataFrame, limit: int = LIMIT, delay: str | None = None) -> DataFrame:
    """The same on a stream, a column ``allowed`` included; only the latest token of each user is state.

    With ``delay`` (how late events may come) the watermark drops a token KEPT seconds after its issue; a confirm after
    that is unknown instead of expired.  Without it state stays, so that replays equal the batch form.  Events of one
    user are in order within a micro-batch and across micro-batches as they come.
    """
    timeout = GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    if delay:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    allowed = F.coalesce(F.col("allowed"), F.lit(False)) if "allowed" in events.columns else F.lit(True)
    rows = events.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind", allowed.alias("allowed"))
    return rows.groupBy("user_id").applyInPandasWithState(_advancing(limit), OUTCOMES, "token long, at long, used boolean", "append", timeout)
