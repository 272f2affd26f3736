"""Splits that keep related records together (problem 4).

Records are linked by everything that names the same entity, here the written forms of a template group; connected
components of these links are never divided.  Which components go to which split is a subset-sum problem over the
multiplicities of component sizes, solved with bitsets, so the totals come as close to the wanted shares as whole
components allow: exactly for splits of up to SPAN rows.  A larger split first takes of every size its proportional part
but RESERVE components, and the rest is solved exactly if it has at most SPAN rows, in units of rest / SPAN rows
otherwise, which may miss by one unit for each component taken there; ``assign`` says nothing else than what it did, and
the report of actual shares shows what was missed.

Defined results: a record without a group is a component of its own; ways of writing one group are one; an empty table
gives no rows; ties between components of one size are broken by a hash of their name; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.llm.components import components

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Largest sum, in rows or units, for which a bitset and the table to read the solution from are made: 5 bytes each on the driver.
SPAN = 1 << 21
#: Components of each size that stay free when a proportional part is taken beforehand.
RESERVE = 8
#: Components that one task puts in order.
PLACED = 500_000


def closest_subset(sizes: dict[int, int], target: int, span: int = SPAN) -> dict[int, int]:
    """How many items of each size to take so that their sum comes closest to ``target``; of two sums equally close the smaller.

    Exact for targets up to ``span``; see above for larger ones.  Every count is split into 1, 2, 4, ... items, each such piece is
    added to the sums that can be reached, and for each sum the piece that reached it first is kept: what it leaves was
    reached before, so the solution is read off without keeping a bitset for each piece.
    """
    taken = dict.fromkeys(sizes, 0)
    total = sum(s * c for s, c in sizes.items())
    if target <= 0 or not total:
        return taken
    left = target
    if target > span:
        share = min(1.0, target / total)
        taken = {s: max(0, int(c * share) - RESERVE) for s, c in sizes.items()}
        left = max(0, target - sum(s * n for s, n in taken.items()))
    unit = max(1, -(-left // span))
    goal = left // unit
    # a sum beyond twice the goal is farther from it than taking nothing
    reach = np.zeros(2 * goal + 1, bool)
    reach[0] = True
    by = np.full(2 * goal + 1, -1, np.int32)
    pieces: list[tuple[int, int]] = []
    for s in sorted(sizes, reverse=True):
        rest, step = min(sizes[s] - taken[s], 2 * left // s + 1), 1
        while rest > 0 and not reach[goal]:
            n = min(step, rest)
            weight = -(-s // unit) * n
            if 0 < weight < len(reach):
                new = np.flatnonzero(reach[: len(reach) - weight] & ~reach[weight:]) + weight
                by[new] = len(pieces)
                reach[new] = True
                pieces.append((s, n))
            rest -= n
            step *= 2
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at:
        s, n = pieces[by[at]]
        taken[s] += n
        at -= -(-s // unit) * n
    # sizes were rounded up to units; what that left open is filled up greedily, the larger sizes first
    missing = target - sum(s * n for s, n in taken.items())
    if unit > 1:
        for s in sorted(sizes, reverse=True):
            more = max(0, min(sizes[s] - taken[s], missing // s))
            taken[s] += more
            missing -= s * more
    return taken


def split_plan(sizes: dict[int, int], shares: dict[str, float]) -> dict[str, dict[int, int]]:
    """For each split but the first, how many components of each size it gets; the first gets the rest."""
    total = sum(s * c for s, c in sizes.items())
    left, plan = dict(sizes), {}
    for name in list(shares)[1:]:
        plan[name] = closest_subset(left, round(total * shares[name]))
        left = {s: c - plan[name][s] for s, c in left.items() if c > plan[name][s]}
    return plan


def record_components(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records (row_id, name) and links (u, v) between names -> (row_id, component)."""
    named = components(links)
    return records.join(named.hint("merge"), records["name"] == named["node"], "left").select("row_id", F.coalesce("component", F.concat(F.lit("row:"), F.col("row_id").cast("string"))).alias("component"))


def assign(records: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(row_id, component) -> (row_id, component, split): whole components, totals as close to the shares as they can be."""
    shares = shares or SHARES
    spark = records.sparkSession
    sized = records.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # a table of n rows has at most sqrt(2 n) component sizes
    sizes = {r["size"]: r["count"] for r in sized.groupBy("size").count().collect()}
    plan, first = split_plan(sizes, shares), next(iter(shares))
    ranges = []
    for s, c in sizes.items():
        start = 0
        for name, taken in plan.items():
            if taken.get(s):
                ranges.append((s, name, start, start + taken[s]))
                start += taken[s]
        ranges.append((s, first, start, c))
    table = spark.createDataFrame(ranges, "size long, split string, low long, high long")
    # a component's place among those of its size, counted in buckets so that no task sorts a whole size
    placed = sized.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(max(256, sum(sizes.values()) // PLACED))))
    counts = placed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("here"))
    before = counts.select("size", "bucket", (F.sum("here").over(W.partitionBy("size").orderBy("bucket")) - F.col("here")).alias("before"))
    inner = placed.withColumn("place", F.row_number().over(W.partitionBy("size", "bucket").orderBy("component")))
    ranked = inner.join(before, ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    chosen = ranked.join(table, (ranked["size"] == table["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("component", "split")
    return records.join(chosen.hint("merge"), "component").select("row_id", "component", "split")
