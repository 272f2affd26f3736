"""New batches against everything accepted before (problem 2): Bloom filters, then a persistent store of rare pieces.

The history is a table of blocks in the shared folder: for each batch and each part of the keys one row with the rarest
pieces of the batch's texts, as many as the prefix filter needs to lose no pair (``rare_pieces``), sorted by key and set
size, with a Bloom filter of the keys beside them.  The table is bucketed by part, so it is read in its buckets and never
shuffled or compared with itself.  A new batch is cut into blocks; the filters, which alone are read for that, say which
parts of which batches can know one of its keys; only those are read, and in each part the new texts are compared with
the old ones of the same key, by exclusive-or and bit counts of sketches, tile by tile, within the range of sizes that
leaves room for the wanted coverage.  A new text may be the smaller or the larger of a pair: of the smaller the index
pieces count, of the larger the probe pieces.  Pairs that pass are verified on the whole texts.  The batch's blocks and
filters are appended; when there are MERGE of them, they are merged part by part into one level, so a part's filters stay
few.  ``History.open`` goes on with a store that an earlier session left.

What is rare is counted once, over all of the first load; a different order of pieces would cost comparisons, no pairs.
Keys are dealt out to cells for as many texts as the store is made for (``expected``).

Defined results: null, empty and blank texts neither match nor are stored; copies within one batch match the
same earlier rows; rows without a batch number take no part; an empty history matches nothing; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from typing import Iterator  # noqa: UP035

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.canon import canonical_dense
from quillmere.llm.grams import Commonness, hashed_bigrams, mix
from quillmere.llm.neartext import RARE_PIECE, ROWS_PER_PART, SIMILARITY, TILE, bucket_blocks, hashed_classes, opened_blocks, radius, representatives, verified
from quillmere.session import scratch, settle

#: Bits and hash functions of a filter for each key in it.
BITS, HASHES = 12, 5
#: Batches that are merged into one level.
MERGE = 16
#: Ranges of up to so many old rows are laid out pair by pair, longer ones compared in tiles; and pairs laid out at once.
FEW, PAIRS = 512, 250_000

LEVEL = "part int, keys binary, texts binary, places binary, first binary, uid binary, size binary, s0 binary, s1 binary, bits binary"
_KINDS = {"keys": "<u4", "texts": "<u4", "places": "<u1", "uid": "<i8", "size": "<u4", "s0": "<u8", "s1": "<u8"}


def bloom_bits(keys: np.ndarray) -> np.ndarray:
    """A Bloom filter, its size a power of two fit for its keys."""
    size = 1 << max(6, int(np.ceil(np.log2(max(1, len(keys)) * BITS))))
    bits = np.zeros(size, bool)
    for i in range(HASHES):
        bits[(mix(keys ^ np.uint64(0xB100 + i)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def bloom_has(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    size = len(packed) * 8
    found = np.ones(len(keys), bool)
    for i in range(HASHES):
        at = (mix(keys ^ np.uint64(0xB100 + i)) & np.uint64(size - 1)).astype(np.int64)
        found &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found


def level_of(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Bucket rows of one part in the order of the store: texts by size, rows by key and size."""
    order = np.lexsort((held["uid"], held["size"]))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    at = np.argsort(held["key"].astype(np.uint64) << np.uint64(32) | rank[held["text"]].astype(np.uint64))
    return {"keys": held["key"][at], "texts": rank[held["text"]][at], "places": held["place"][at], "first": held["first"][at], **{c: held[c][order] for c in ("uid", "size", "s0", "s1")}}


def packed_level(part: int, level: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row of the store."""
    row = {c: level[c].astype(k).tobytes() for c, k in _KINDS.items()} | {"first": np.packbits(level["first"]).tobytes(), "bits": bloom_bits(np.unique(level["keys"]).astype(np.uint64)).tobytes()}
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), **{c.split()[0]: pa.array([row[c.split()[0]]], pa.binary()) for c in LEVEL.split(", ")[1:]}})


def opened_level(row: dict) -> dict[str, np.ndarray]:
    level = {c: np.frombuffer(row[c], k) for c, k in _KINDS.items()}
    return level | {"first": np.unpackbits(np.frombuffer(row["first"], np.uint8), count=len(level["keys"])).astype(bool)}


def across(x: dict[str, np.ndarray], y: dict[str, np.ndarray], least: float, larger: bool, tile: int = TILE):
    """Pairs (index in x's texts, in y's) with one key that are near enough, of an index row of x and a set of y that isn't
    smaller, or (``larger``) of any row of x and an index row of a smaller set of y.  The work follows x, but for one look at y's rows."""
    size_x, size_y = x["size"].astype(np.int64), y["size"].astype(np.int64)
    rows = np.arange(len(x["keys"])) if larger else np.flatnonzero(x["first"])
    key = x["keys"][rows].astype(np.uint64) << np.uint64(32)
    text = x["texts"][rows].astype(np.int64)
    of = size_x[text]
    theirs = y["texts"][y["first"]] if larger else y["texts"]
    packed = (y["keys"][y["first"]] if larger else y["keys"]).astype(np.uint64) << np.uint64(32) | size_y[theirs].astype(np.uint64)
    least_of, most_of = (np.ceil(least * of - 1e-9), of - 1) if larger else (of, np.floor(of / least + 1e-9))
    # at the first piece that two sets share, they have no more in common than what follows it
    rest = of - x["places"][rows]
    most_of = np.minimum(most_of, np.floor(rest * (1 + least) / least - of + 1e-6))
    low = np.searchsorted(packed, key | least_of.astype(np.uint64))
    high = np.searchsorted(packed, key | np.maximum(most_of, 0).astype(np.uint64), side="right")
    n = np.where(most_of >= least_of, high - low, 0)

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.bitwise_count(x["s0"][a] ^ y["s0"][b]).astype(np.int64) + np.bitwise_count(x["s1"][a] ^ y["s1"][b])
        ok = apart <= radius(size_x[a], size_y[b], least)
        return a[ok], b[ok]

    short = np.flatnonzero((n > 0) & (n <= FEW))
    total = np.cumsum(n[short])
    widest = np.minimum(128, radius(of, np.maximum(most_of, 0), least)).astype(np.uint8)
    mine_0, mine_1, their_0, their_1 = x["s0"][text], x["s1"][text], y["s0"][theirs], y["s1"][theirs]
    begin = 0
    while begin < len(short):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, side="right")))
        some = short[begin:end]
        c = n[some]
        at = np.repeat((low[some] - (np.cumsum(c) - c)).astype(np.int32), c) + np.arange(int(c.sum()), dtype=np.int32)
        apart = np.bitwise_count(np.repeat(mine_0[some], c) ^ their_0[at])
        apart += np.bitwise_count(np.repeat(mine_1[some], c) ^ their_1[at])
        # the radius for the largest set that a row may meet comes first, that for the pair's own sets after it
        kept = np.flatnonzero(apart <= np.repeat(widest[some], c))
        yield near(np.repeat(text[some], c)[kept], theirs[at[kept]].astype(np.int64))
        begin = end
    long = np.flatnonzero(n > FEW)
    if not len(long):
        return
    # rows of one key stand together, by size: up to a tile of them is compared with all that any of them may meet
    cuts = np.flatnonzero(np.concatenate([[True], key[long][1:] != key[long][:-1]]))
    words, apart, other, close = np.empty((tile, 4 * tile), np.uint64), np.empty((tile, 4 * tile), np.uint8), np.empty((tile, 4 * tile), np.uint8), np.empty((tile, 4 * tile), bool)
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(long)], strict=True):
        begin, last = int(low[long[s:e]].min()), int(high[long[s:e]].max())
        every = theirs[begin:last].astype(np.int64)
        s0, s1, sizes = y["s0"][every], y["s1"][every], size_y[every]
        for i in range(s, e, tile):
            mine = long[i : min(i + tile, e)]
            a, m = text[mine], len(mine)
            x0, x1, end = x["s0"][a][:, None], x["s1"][a][:, None], int(high[mine].max()) - begin
            for j in range(int(low[mine].min()) - begin, end, 4 * tile):
                k = min(4 * tile, end - j)
                # buffers are kept: a tile's temporaries would cost more than its comparisons
                w, p, q, ok = (buffer.reshape(-1)[: m * k].reshape(m, k) for buffer in (words, apart, other, close))
                np.bitwise_count(np.bitwise_xor(x0, s0[None, j : j + k], out=w), out=p)
                np.bitwise_count(np.bitwise_xor(x1, s1[None, j : j + k], out=w), out=q)
                np.less_equal(np.add(p, q, out=p), np.uint8(min(128, radius(of[mine[-1]], sizes[j + k - 1], least))), out=ok)
                if ok.any():
                    r, c = np.divmod(np.flatnonzero(ok), k)
                    at = begin + j + c
                    inside = (at >= low[mine[r]]) & (at < high[mine[r]])
                    yield near(a[r[inside]], every[j + c[inside]])


class History:
    """Blocks and filters of all accepted batches, in a folder that outlives the session."""

    def __init__(self, spark: SparkSession, path: str, common: Commonness, least: float, parts: int):
        self.spark, self.path, self.common, self.least, self.parts = spark, path, common, least, parts
        self.batches: list[int] = []
        self.version = 0

    @classmethod
    def create(cls, spark: SparkSession, path: str, common: Commonness, least: float = SIMILARITY, expected: int = 0) -> History:
        """A new store, with parts and cells for so many texts, at least those of the first load."""
        texts = max(expected, common.texts)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts * 24 // ROWS_PER_PART)
        made = cls(spark, path, Commonness(common.classes, texts, common.rare), least, parts)
        made._note()
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The store that stands in a folder, with all that it has accepted."""
        notes = spark.read.parquet(f"{path}/notes")
        r = notes.orderBy(F.desc("version"), F.desc(F.size("batches"))).first()
        made = cls(spark, path, Commonness(bytes(r["classes"]), r["texts"], r["rare"]), r["least"], r["parts"])
        made.batches, made.version = list(r["batches"]), r["version"]
        if made.batches:
            made._table()
        return made

    def _note(self) -> None:
        """What is needed to open the store; the newest row counts, so it is written last."""
        row = (self.version, self.batches, self.parts, self.least, self.common.texts, self.common.rare, bytearray(self.common.classes))
        self.spark.createDataFrame([row], "version int, batches array<int>, parts int, least double, texts long, rare double, classes binary").coalesce(1).write.mode("append").parquet(f"{self.path}/notes")

    @property
    def name(self) -> str:
        return f"history_{hashlib.md5(self.path.encode()).hexdigest()}_{self.version}"

    def _table(self) -> None:
        """Make the folder known to the session as a bucketed table."""
        self.spark.sql(f"create table if not exists {self.name} ({LEVEL}, batch int) using parquet partitioned by (batch) clustered by (part) into {self.parts} buckets location '{self.path}/level-{self.version}'")
        self.spark.catalog.recoverPartitions(self.name)

    def _store(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, levels: DataFrame, batch: int) -> None:
        writer = levels.withColumn("batch", F.lit(batch)).write.format("parquet").option("compression", "zstd").partitionBy("batch").bucketBy(self.parts, "part")
        if self.spark.catalog.tableExists(self.name):
            writer.mode("append").saveAsTable(self.name)
        else:
            writer.option("path", f"{self.path}/level-{self.version}").saveAsTable(self.name)

    def accept(self, batch: int, texts: DataFrame) -> DataFrame | None:
        """(uid, text) of a new batch -> its pairs (a, b), b accepted before, that may be nearly the same; then the batch is stored."""
        least, earlier = self.least, list(self.batches)
        if batch in earlier:
            raise ValueError(f"batch {batch} was accepted before")
        blocks = bucket_blocks(texts.withColumn("side", F.lit(0)), self.common, least, self.parts, True, places=True)

        def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [opened_blocks(b) for b in batches]
            merged: dict[str, np.ndarray] = {}
            base = np.cumsum([0, *(len(h["uid"]) for h in held)])
            for c in ("key", "first", "place", "uid", "size", "s0", "s1"):
                merged[c] = np.concatenate([h[c] for h in held])
            merged["text"] = np.concatenate([h["text"] + b for h, b in zip(held, base, strict=False)])
            yield packed_level(key[0].as_py(), level_of(merged))

        self._write(blocks.groupBy("part").applyInArrow(gather, LEVEL), batch)
        self.batches.append(batch)
        self._note()
        return self._look_up(batch, earlier) if earlier else None

    def _look_up(self, batch: int, earlier: list[int]) -> DataFrame:
        least = self.least
        new = self._store().where(F.col("batch") == batch)
        filters = self._store().where(F.col("batch").isin(earlier)).select("part", "batch", "bits")

        def screen(_, new: pa.Table, old: pa.Table) -> pa.Table:
            known = [False] * old.num_rows
            if new.num_rows:
                keys = np.unique(np.concatenate([np.frombuffer(k.as_py(), "<u4") for k in new.column("keys")])).astype(np.uint64)
                known = [bool(bloom_has(np.frombuffer(b.as_py(), np.uint8), keys).any()) for b in old.column("bits")]
            return old.select(["part", "batch"]).filter(pa.array(known, pa.bool_()))

        found = new.select("part", "keys").groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(screen, "part int, batch int").collect()  # at most a row for each part and level
        if not found:
            return self.spark.createDataFrame([], "a long, b long")
        where, when = {r["part"] for r in found}, {r["batch"] for r in found}
        old = self._store().where(F.col("batch").isin(sorted(when)) & F.col("part").isin(sorted(where))).drop("bits", "batch")

        def compare(_, new: pa.Table, old: pa.Table) -> pa.Table:
            low, high = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for x in (opened_level(r) for r in new.to_pylist()):
                for i in range(old.num_rows):
                    y = opened_level(old.slice(i, 1).to_pylist()[0])
                    both = np.concatenate([np.zeros(0, np.int64), *(a << 32 | b for a, b in across(x, y, least, False)), *(a << 32 | b for a, b in across(x, y, least, True))])
                    both = np.unique(both)
                    low.append(x["uid"][both >> 32])
                    high.append(y["uid"][both & 0xFFFFFFFF])
            return pa.table({"a": pa.array(np.concatenate(low).astype(np.int64)), "b": pa.array(np.concatenate(high).astype(np.int64))})

        pairs = new.drop("bits", "batch").groupBy("part").cogroup(old.groupBy("part")).applyInArrow(compare, "a long, b long")
        return settle(pairs, f"candidates_{batch}")

    def merge(self) -> None:
        """All levels of a part become one, in a new version of the table; the old one stays until the folder is cleaned."""

        def together(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels = [opened_level(r) for b in batches for r in b.to_pylist()]
            base = np.cumsum([0, *(len(x["uid"]) for x in levels)])
            merged = {c: np.concatenate([x[c] for x in levels]) for c in ("first", "uid", "size", "s0", "s1")} | {"key": np.concatenate([x["keys"] for x in levels]), "place": np.concatenate([x["places"] for x in levels])}
            merged["text"] = np.concatenate([x["texts"].astype(np.int64) + b for x, b in zip(levels, base, strict=False)])
            yield packed_level(key[0].as_py(), level_of(merged))

        levels = self._store().drop("bits", "batch").groupBy("part").applyInArrow(together, LEVEL)
        self.version += 1
        last = self.batches[-1]
        self._write(levels, last)
        self.batches = [last]
        self._note()


def already_accepted(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(uid, batch, text) -> (uid, match): rows whose text was accepted in an earlier batch, exactly or nearly, and the smallest such uid."""
    spark = rows.sparkSession
    rows = rows.where("batch is not null")
    hashed = hashed_classes(rows, canonical_dense(F.col("text")), ["batch"])
    reps = settle(representatives(hashed, F.first("batch").alias("batch")), "representatives")
    loads = {r["batch"]: r["n"] for r in reps.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect()}  # one row for each batch
    if len(loads) < 2:
        return spark.createDataFrame([], "uid long, match long")
    chosen = settle(rows.select("uid", "text").join(reps.select(F.col("rep").alias("uid"), "batch"), "uid"), "incoming", ["batch"])
    common = Commonness.fit(chosen.where(F.col("batch") == next(iter(loads))), "text", hashed_bigrams, RARE_PIECE)
    history = History.create(spark, scratch(spark, "history"), common, least, sum(loads.values()))
    found = []
    for b in loads:
        found.append(history.accept(b, chosen.where(F.col("batch") == b)))
        if len(history.batches) >= MERGE:
            history.merge()
    pairs = found[1]
    for more in found[2:]:
        pairs = pairs.unionAll(more)
    match = verified(pairs.distinct(), chosen, least).groupBy("a").agg(F.min("b").alias("match"))
    members = hashed.join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("rep").alias("a"), "uid")
    return match.join(members, "a").select("uid", "match")
