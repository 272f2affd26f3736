"""Mixing sources to target shares of tokens (problem 8): balanced sampling by the cube method.

Every distinct text of a source is used ``e`` times on average, where ``e`` follows from the source's share and what it
holds: the whole part of ``e`` for every text, and the fraction as a probability of one more use.  The cube method turns
these probabilities into decisions: in its flight it moves the probabilities of a few texts at a time along directions
in which the sums of tokens and of documents stay the same, until one is 0 or 1.  Blocks of texts fly in parallel; what
is left undecided, two texts a block at most, flies again per source, and a reserve of a few hundred texts that didn't
fly lands where tokens fit best.

The size of the mixture is the largest at which no source would need a text more than ``max_repeats`` times, unless a
total is given; then a source that can't fill its share gives what it can.

Defined results: null, empty and blank texts take no part; copies of a text count as one text, that of the smallest
doc_id; names of sources are compared in one form; sources without a target take no part, and targets without
documents are reported with a share of 0; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.bytepairs import VOCABULARY, token_counts
from quillmere.session import settle

#: Texts in a block of the flight.
BLOCK = 10_000
#: Texts of a source that are kept for the landing.
RESERVE = 256


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1, sums of p and of p * tokens kept."""
    p = p.astype(np.float64).copy()
    weight = tokens.astype(np.float64).tolist()
    value = p.tolist()
    draws = rng.random(len(p) + 3).tolist()
    active: list[int] = []
    drawn = 0
    for i in range(len(p)):
        if 0.0 < value[i] < 1.0:
            active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        x, y, z = weight[b] - weight[c], weight[c] - weight[a], weight[a] - weight[b]
        if x == y == z == 0.0:
            x, y = 1.0, -1.0
        up = down = np.inf
        for at, d in ((a, x), (b, y), (c, z)):
            if d > 0:
                up, down = min(up, (1 - value[at]) / d), min(down, value[at] / d)
            elif d < 0:
                up, down = min(up, -value[at] / d), min(down, (value[at] - 1) / d)
        step = up if draws[drawn] * (up + down) < down else -down
        drawn += 1
        active = []
        for at, d in ((a, x), (b, y), (c, z)):
            v = value[at] + step * d
            value[at] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            if 0.0 < value[at] < 1.0:
                active.append(at)
    return np.array(value)


def landing(p: np.ndarray, tokens: np.ndarray, base: np.ndarray, most: np.ndarray, reserve: np.ndarray, goal: float, rng: np.random.Generator) -> np.ndarray:
    """The last decisions of a source: uses beyond ``base`` whose tokens come as close to ``goal`` as the reserve allows.

    Texts outside the reserve are decided by the flight and, for the last two, by their probabilities.  Then texts of the
    reserve are used once more or once less, one or two at a time and never beyond 0 and ``most`` uses, as long as that
    brings the total nearer.
    """
    p = p.copy()
    p[~reserve] = flight(p[~reserve], tokens[~reserve], rng)
    p[reserve] = flight(p[reserve], tokens[reserve], rng)
    open_at = (p > 0) & (p < 1)
    p[open_at] = rng.random(int(open_at.sum())) < p[open_at]
    pool = np.flatnonzero(reserve)
    for _ in range(50 * len(pool) + 1):
        off = goal - float((p * tokens).sum())
        uses = (base + p)[pool]
        up, down = pool[uses < most[pool]], pool[uses > 0]
        text = np.concatenate([up, down])
        if not len(text) or off == 0:
            break
        step = np.concatenate([np.ones(len(up)), -np.ones(len(down))])
        change = step * tokens[text]
        single = np.abs(off - change)
        both = np.abs(off - change[:, None] - change[None])
        both[text[:, None] == text[None]] = np.inf
        i, (x, y) = int(single.argmin()), np.unravel_index(int(both.argmin()), both.shape)
        moves = [i] if single[i] <= both[x, y] else [int(x), int(y)]
        if min(single[i], both[x, y]) >= abs(off):
            break
        p[text[moves]] += step[moves]
    return p


def _fly(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("doc_id")
    rng = np.random.default_rng(int(rows.column("doc_id")[0].as_py()) & 0xFFFFFFFF)
    p = flight(rows.column("p").to_numpy(), rows.column("n_tokens").to_numpy(), rng)
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def _land(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("doc_id")
    p, tokens, reserve = rows.column("p").to_numpy(), rows.column("n_tokens").to_numpy(), rows.column("block").to_numpy() < 0
    # blocks kept their sums, so what these texts promise together is what the source still lacks
    goal = float((p * tokens).sum())
    p = landing(p, tokens, rows.column("base").to_numpy(), rows.column("most").to_numpy(), reserve, goal, np.random.default_rng(int(rows.column("doc_id")[0].as_py()) & 0xFFFFFFFF))
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, source, text), targets (source, target_share, max_repeats) -> uses of texts, and the report of shares."""
    spark = docs.sparkSession
    # ways of writing a source are one: its shares add up, its strictest cap counts
    targets = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    aims = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}  # a table of targets, one row for each source
    wanted = docs.where(F.col("source").isin(list(aims)) & F.col("text").rlike(r"(?U)\S"))
    hashed = wanted.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    counted = settle(token_counts(hashed, "text", vocabulary), "tokens")
    units = counted.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("u")).select("u.*")
    held = {r["source"]: (r["tokens"], r["docs"]) for r in units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    held = {s: v for s, v in held.items() if v[0] and aims[s][0] > 0}
    whole = sum(aims[s][0] for s in held) or 1.0
    if total is None:
        total = min((aims[s][1] * held[s][0] / (aims[s][0] / whole) for s in held), default=0.0)
    uses = {s: min(float(aims[s][1]), total * aims[s][0] / whole / held[s][0]) for s in held}
    plan = spark.createDataFrame([(s, float(uses[s]), max(1, -(-held[s][1] // BLOCK)), held[s][1], aims[s][1]) for s in held], "source string, uses double, blocks long, docs long, most long")
    planned = units.join(F.broadcast(plan), "source")  # one row for each target
    # about RESERVE texts of each source don't fly but settle the landing
    block = F.when(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("docs")) < RESERVE, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    start = planned.select("doc_id", "source", "n_tokens", F.floor(F.col("uses") + 1e-9).alias("base"), F.greatest(F.lit(0.0), F.col("uses") - F.floor(F.col("uses") + 1e-9)).alias("p"), block.cast("long").alias("block"), "most")
    schema = "doc_id long, source string, n_tokens long, base long, p double, block long, most long"
    flown = settle(start.where("block >= 0").groupBy("source", "block").applyInArrow(_fly, schema).unionAll(start.where("block < 0")), "flown")
    undecided = flown.where("p > 0 and p < 1")  # two texts of each block, and the reserve
    landed = undecided.groupBy("source").applyInArrow(_land, schema)
    decided = flown.where("p <= 0 or p >= 1").unionAll(landed)
    used = decided.select("doc_id", "source", (F.col("base") + F.round("p").cast("long")).alias("repeats"), "n_tokens").where("repeats > 0")
    sums = used.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("repeats").alias("most_repeats"))
    every = sums.agg(F.sum("tokens").alias("all_tokens"))
    report = (
        targets.join(sums, "source", "left")
        .crossJoin(every)  # one row
        .select("source", "target_share", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    )
    return used, report
