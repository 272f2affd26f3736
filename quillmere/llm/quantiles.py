"""Percentiles of large numeric columns (problem 3): relative-rank compactors that can be merged.

A sketch is a list of compactors.  A full compactor sorts its values, leaves its largest values alone and passes
every other one of the rest on to the next level, where each counts twice as much.  How far down it may compact
follows the paper on relative-error streaming quantiles (Cormode, Karnin, Liberty, Thaler and Vesely, 2021), so the
rank error at a quantile q is proportional to 1 - q: the extreme upper percentiles, which matter for latencies, are
the most exact.  Sketches of tasks, days or partitions merge level by level with the same bound.

Defined results: null and NaN values are left out; a null group is a group; a group without values has no row; up to
a compactor's capacity results are exact; ties count as often as they occur; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import zlib
from typing import Iterator  # noqa: UP035

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a section of a compactor; the relative error falls in proportion to it.
SECTION = 64
#: Sections at the start.
SECTIONS = 3
#: Groups that a task holds at once before it passes its sketches on.
GROUPS = 2048


class RelativeRank:
    """A mergeable quantile sketch with multiplicative rank error at the upper tail."""

    def __init__(self, section: int = SECTION):
        self.section = section
        self.n, self.low, self.high = 0, np.inf, -np.inf
        self.levels: list[np.ndarray] = []
        self.state: list[int] = []

    def capacity(self, level: int) -> tuple[int, int, int]:
        """Sections, their size, and room of a compactor: with every doubling of its compactions sections grow in number and shrink."""
        sections, size, done = SECTIONS, float(self.section), self.state[level]
        while done >= 1 << (sections - 1) and size / np.sqrt(2) >= 4:
            sections, size = sections * 2, size / np.sqrt(2)
        even = 2 * round(size / 2)
        return sections, even, 2 * sections * even

    def add(self, values: np.ndarray) -> None:
        values = np.asarray(values, np.float64)
        values = values[~np.isnan(values)]
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        self._grow(1)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compress()

    def _grow(self, levels: int) -> None:
        while len(self.levels) < levels:
            self.levels.append(np.zeros(0))
            self.state.append(0)

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            sections, size, room = self.capacity(level)
            if len(self.levels[level]) > room:
                values = np.sort(self.levels[level])
                done = self.state[level]
                free = min(sections, (~done & (done + 1)).bit_length())  # trailing ones of the count, plus one
                keep = room // 2 + (sections - free) * size
                cut = len(values) - keep
                cut -= cut & 1
                coin = zlib.crc32(values.tobytes(), done << 8 ^ level) >> 7 & 1  # a hash of what is compacted: as good as random, and the same if a task runs again
                self._grow(level + 2)
                self.levels[level + 1] = np.concatenate([self.levels[level + 1], values[coin:cut:2]])
                self.levels[level] = values[cut:]
                self.state[level] += 1
            level += 1

    def merge(self, other: RelativeRank) -> None:
        if not other.n:
            return
        self._grow(len(other.levels))
        for i, values in enumerate(other.levels):
            self.levels[i] = np.concatenate([self.levels[i], values])
            self.state[i] |= other.state[i]
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self._compress()

    def quantiles(self, shares: list[float]) -> list[float]:
        """The smallest kept values whose rank reaches each share of all values; exact minimum and maximum at 0 and 1."""
        values = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(v), 1 << i) for i, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, rank = values[order], np.cumsum(weight[order])
        out = []
        for q in shares:
            at = min(int(np.searchsorted(rank, max(1, np.ceil(q * self.n - 1e-9)))), len(values) - 1)
            out.append(self.low if q <= 0 else self.high if q >= 1 else float(values[at]))
        return out

    def pack(self) -> bytes:
        head = [self.section, self.n, self.low, self.high, len(self.levels), *(x for i, v in enumerate(self.levels) for x in (self.state[i], len(v)))]
        return np.concatenate([np.array(head, np.float64), *self.levels]).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> RelativeRank:
        x = np.frombuffer(data, np.float64)
        made = cls(int(x[0]))
        made.n, made.low, made.high, levels = int(x[1]), float(x[2]), float(x[3]), int(x[4])
        at = 5 + 2 * levels
        for i in range(levels):
            made.state.append(int(x[5 + 2 * i]))
            made.levels.append(x[at : at + int(x[6 + 2 * i])].copy())
            at += int(x[6 + 2 * i])
        return made


def sketches(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One sketch for each group: each task sketches its own rows, then only sketches are shuffled and merged."""
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    def partial(batches):
        held: dict[tuple, RelativeRank] = {}
        types: list[pa.DataType] = []

        def out():
            keys = list(held)
            columns = [pa.array([k[i] for k in keys], types[i]) for i in range(len(groups))]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array([held[k].pack() for k in keys], pa.binary())], names=[*groups, "sketch"])
            held.clear()
            return batch

        for batch in batches:
            if not types:
                types.extend(batch.column(i).type for i in range(len(groups)))
            table = pa.Table.from_batches([batch])
            codes = np.zeros(len(batch), np.int64)
            kinds: list[list] = []
            for g in groups:
                coded = table.column(g).combine_chunks().dictionary_encode(null_encoding="encode")
                kinds.append(coded.dictionary.to_pylist())
                codes = codes * max(1, len(kinds[-1])) + coded.indices.to_numpy(zero_copy_only=False)
            values = batch.column(len(groups)).to_numpy(zero_copy_only=False).astype(np.float64)
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else []
            for s, e in zip(starts, [*starts[1:], len(codes)], strict=True):
                code, key = int(codes[s]), []
                for kind in reversed(kinds):
                    key.append(kind[code % max(1, len(kind))])
                    code //= max(1, len(kind))
                held.setdefault(tuple(reversed(key)), RelativeRank()).add(values[s:e])
            if len(held) > GROUPS:
                yield out()
        if held:
            yield out()

    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias(value))
    return merged(rows.mapInArrow(partial, f"{fields}, sketch binary"), groups)


def merged(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of the same group merged, as of several days or partitions."""
    fields = ", ".join(f"`{g}` {parts.schema[g].dataType.simpleString()}" for g in groups)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = RelativeRank()
        for batch in batches:
            for data in batch.column("sketch"):
                whole.merge(RelativeRank.unpack(data.as_py()))
        if whole.n:
            yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([whole.pack()], pa.binary())], names=[*groups, "sketch"])

    return parts.select(*groups, "sketch").groupBy(*groups).applyInArrow(merge, f"{fields}, sketch binary")


def percentiles(parts: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """Values at the given shares of each sketch, with its count, minimum and maximum."""
    fields = ", ".join(f"`{g}` {parts.schema[g].dataType.simpleString()}" for g in groups)

    def read(batches):
        for batch in batches:
            made = [RelativeRank.unpack(x.as_py()) for x in batch.column(len(groups))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(groups)], pa.array([m.n for m in made], pa.int64()), pa.array([m.low for m in made], pa.float64()), pa.array([m.high for m in made], pa.float64()), pa.array([m.quantiles(shares) for m in made], pa.list_(pa.float64()))],
                names=[*groups, "n", "low", "high", "at"],
            )

    return parts.select(*groups, "sketch").mapInArrow(read, f"{fields}, n long, low double, high double, at array<double>")


#: Sketches that are sent to every task may have this many bytes in all; beyond that rows and sketches are shuffled together.
SENT_BYTES = 64 << 20
#: Rows of a group that one task ranks at once when they are shuffled.
RANKED = 500_000


def _ranks(sketch: RelativeRank, values: np.ndarray) -> np.ndarray:
    """Share of the sketched values that are at most each value."""
    kept = np.concatenate(sketch.levels)
    weight = np.concatenate([np.full(len(v), 1 << i, np.float64) for i, v in enumerate(sketch.levels)])
    order = np.argsort(kept, kind="stable")
    at = np.searchsorted(kept[order], values, "right")
    return np.concatenate([[0.0], np.cumsum(weight[order])])[at] / max(1, sketch.n)


def ranked_rows(df: DataFrame, key: str, group: str, value: str, parts: DataFrame) -> DataFrame:
    """Every row with a value, and the share of its group's values that are at most its own, by the group's sketch.

    Sketches of a bounded size go to all tasks, checked by their sum of bytes; larger ones meet the rows in a shuffle,
    with each group dealt out to so many tasks that none gets more than about RANKED rows of it.
    """
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(key, group, F.col(value).cast("double").alias(value))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{group}` {df.schema[group].dataType.simpleString()}, `{value}` double, rank double"
    held = parts.agg(F.sum(F.length("sketch")).alias("bytes")).first()["bytes"] or 0
    if held <= SENT_BYTES:
        sent = spark.sparkContext.broadcast({r[group]: bytes(r["sketch"]) for r in parts.select(group, "sketch").collect()})

        def rank(batches):
            made: dict = {}
            for batch in batches:
                coded = batch.column(1).dictionary_encode(null_encoding="encode")
                kinds, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                values = batch.column(2).to_numpy(zero_copy_only=False)
                out = np.full(len(values), np.nan)
                for i, g in enumerate(kinds):
                    if g in sent.value:
                        if g not in made:
                            made[g] = RelativeRank.unpack(sent.value[g])
                        mine = codes == i
                        out[mine] = _ranks(made[g], values[mine])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[key, group, value, "rank"])

        return rows.mapInArrow(rank, schema)

    counts = rows.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / RANKED)).alias("salts")).withColumnRenamed(group, "_g")
    salted = rows.join(counts, F.col(group).eqNullSafe(F.col("_g"))).withColumn("salt", F.pmod(F.xxhash64(key), F.col("salts"))).drop("_g", "salts")
    copies = parts.join(counts, F.col(group).eqNullSafe(F.col("_g"))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).select(group, "salt", "sketch")

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        values = left.column(value).to_numpy()
        share = _ranks(RelativeRank.unpack(right.column("sketch")[0].as_py()), values) if right.num_rows else np.full(len(values), np.nan)
        return pa.table({key: left.column(key), group: left.column(group), value: left.column(value), "rank": pa.array(share)})

    return salted.groupBy(group, "salt").cogroup(copies.groupBy(group, "salt")).applyInArrow(together, schema)
