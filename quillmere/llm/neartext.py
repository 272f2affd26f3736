"""Stages that the near-duplicate operators share: candidates from buckets, exact verification, expansion to rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.session import settle
from quillmere.llm.grams import CHUNK, M1, M2, Commonness, bigrams, dense_points, jaccard, mix, parity_sketch

#: Two texts are nearly the same from this share of common pieces on.
SIMILARITY = 0.70
#: A piece held by less than this share of all texts counts as rare.
RARE_PIECE = 0.002
#: Rows that one bucket may hold; a commoner piece's rows are dealt out to cells of this size, and every two cells meet.
CELL = 1 << 15
#: Pairs that a task holds, to give each once, before it hands them on.
HELD = 8_000_000
#: Rows on a side of a tile.
TILE = 256

BLOCKS = "part int, uid binary, side binary, size binary, s0 binary, s1 binary, rows binary, low binary, high binary, first binary, place binary"
#: Bucket rows that one task compares; the number of parts follows from the number of texts.
ROWS_PER_PART = 1_500_000


def radius(size_a, size_b, least: float):
    """Pieces in which two sets may differ at most if their similarity is ``least`` or more."""
    return np.floor((1 - least) / (1 + least) * (size_a + size_b) + 1e-9)


def probe_length(size: np.ndarray, least: float) -> np.ndarray:
    """Rarest pieces of a set among which one is shared with every similar set that isn't larger."""
    return (size - np.ceil(least * size - 1e-9) + 1).astype(np.int64)


def index_length(size: np.ndarray, least: float) -> np.ndarray:
    """Rarest pieces of a set that have to meet the probe pieces of similar sets that aren't smaller."""
    return (size - np.ceil(2 * least / (1 + least) * size - 1e-9) + 1).astype(np.int64)


def rare_pieces(texts: list[str | None], common: Commonness, least: float, cell: int = CELL) -> dict[str, np.ndarray]:
    """Of each text of a chunk the rarest pieces, rarest first: as many as the prefix filter needs to lose no pair.

    Any two sets with similarity ``least`` or more share one of the first ``index_length`` pieces of the smaller and the
    first ``probe_length`` pieces of the larger, whatever order all texts' pieces are put in.  A text of one character has no
    piece; the character takes its place, so that equal ones meet.  ``place`` is a piece's place in its text's order, 255 at most.
    """
    cps, lens = dense_points(texts)
    row, code = bigrams(cps, lens)
    n = len(lens)
    size = np.bincount(row, minlength=n)
    sketch = parity_sketch(row, code, n)
    h = mix(code + np.uint64(1))
    kind = common.of(h)
    # row, class of commonness, hash: one number each, so one sort puts all in order
    packed = row.astype(np.uint64) << np.uint64(50) | kind.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)
    packed.sort()
    row = (packed >> np.uint64(50)).astype(np.int64)
    start = np.cumsum(size) - size
    place = np.arange(len(row)) - start[row]
    keep = place < probe_length(size, least)[row]
    row, packed, place = row[keep], packed[keep], place[keep]
    near = np.minimum(place, 255).astype(np.uint8)
    key = packed & np.uint64((1 << 44) - 1)
    cells = common.cells((packed >> np.uint64(44) & np.uint64(63)).astype(np.int64), cell)
    first = place < index_length(size, least)[row]
    if (cells > 1).any():
        row, key, first, near = in_cells(row, key, first, near, cells, sketch)
    single = np.flatnonzero(lens == 1)
    if len(single):
        alone = mix(cps[(np.cumsum(lens) - lens)[single]].astype(np.uint64) + M2) >> np.uint64(20)
        row, key, first, near = np.concatenate([row, single]), np.concatenate([key, alone]), np.concatenate([first, np.ones(len(single), bool)]), np.concatenate([near, np.zeros(len(single), np.uint8)])
    return {"row": row, "key": key, "first": first, "place": near, "size": size, "sketch": sketch}


def in_cells(at: np.ndarray, key: np.ndarray, first: np.ndarray, place: np.ndarray, cells: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (text, key, flag, place) where a key with c cells becomes c keys: the text's own cell with each cell.

    How many cells a key has follows from the corpus statistics, so all texts of the key agree, and any two meet in one bucket.
    """
    plain = cells <= 1
    rows, keys, flags, places = [at[plain]], [key[plain]], [first[plain]], [place[plain]]
    for i in np.flatnonzero(~plain).tolist():
        mine = np.uint64(int(mix(sketch[at[i] : at[i] + 1, 0] + np.uint64(1))[0]) % int(cells[i]))
        other = np.arange(cells[i], dtype=np.uint64)
        rows.append(np.full(cells[i], at[i]))
        keys.append(mix(key[i] ^ mix((np.minimum(other, mine) << np.uint64(20) | np.maximum(other, mine)) + np.uint64(1))) & np.uint64((1 << 44) - 1))
        flags.append(np.full(cells[i], first[i]))
        places.append(np.full(cells[i], place[i]))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(flags), np.concatenate(places)


def _labels(spark: SparkSession, parts: int) -> list[int]:
    """For each of so many partitions an integer that Spark's hash puts there, so that parts are spread evenly."""
    found: dict[int, int] = {}
    for r in spark.range(parts * 40).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("i").alias("i")).collect():
        found[r["p"]] = r["i"]
    return [found.get(p, p) for p in range(parts)]


def bucket_blocks(texts: DataFrame, common: Commonness, least: float, parts: int, crossing: bool, cell: int = CELL, places: bool = False) -> DataFrame:
    """(uid, side, text) -> blocks of bucket rows, in columns of bytes, one block for each chunk of texts and part of the keys; with the places of the pieces if they are asked for.

    Unless sides are to be crossed, texts of different sides get different keys and never meet.
    """
    labels = _labels(texts.sparkSession, parts)

    def make(batches):
        for batch in batches:
            uid, side, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            for i in range(0, len(values), CHUNK):
                k = rare_pieces(values[i : i + CHUNK], common, least, cell)
                if not crossing:
                    k["key"] = mix(k["key"] + (side[k["row"] + i].astype(np.uint64) + np.uint64(1)) * M1) & np.uint64((1 << 44) - 1)
                part = (k["key"] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part * CHUNK + k["row"], kind="stable")  # by part, then by text
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                out: dict[str, list] = {c.split()[0]: [] for c in BLOCKS.split(", ")}
                for p in range(parts):
                    mine = order[ends[p] : ends[p + 1]]
                    if not len(mine):
                        continue
                    used, rows = np.unique(k["row"][mine], return_counts=True)
                    # 24 bits of the key: two keys that fall together only cost comparisons
                    key = (k["key"][mine] // np.uint64(parts)).astype(np.uint32)
                    out["part"].append(labels[p])
                    out["uid"].append(uid[used + i].astype("<i8").tobytes())
                    out["side"].append(side[used + i].astype("<u1").tobytes())
                    out["size"].append(k["size"][used].astype("<u4").tobytes())
                    out["s0"].append(k["sketch"][used, 0].tobytes())
                    out["s1"].append(k["sketch"][used, 1].tobytes())
                    out["rows"].append(rows.astype("<u4").tobytes())
                    out["low"].append((key & 0xFFFF).astype("<u2").tobytes())
                    out["high"].append((key >> 16 & 0xFF).astype("<u1").tobytes())
                    out["first"].append(np.packbits(k["first"][mine]).tobytes())
                    out["place"].append(k["place"][mine].tobytes() if places else b"")
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "part" else pa.binary()) for c, v in out.items()})

    return texts.select("uid", "side", "text").mapInArrow(make, BLOCKS)


def opened_blocks(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of the texts of some blocks of one part, and of their bucket rows: key, text (its place among the texts) and flag."""
    kinds = {"uid": "<i8", "side": "<u1", "size": "<u4", "s0": "<u8", "s1": "<u8", "rows": "<u4", "low": "<u2", "high": "<u1", "place": "<u1"}
    got = {c: [np.frombuffer(v.as_py(), t) for v in batch.column(c)] for c, t in kinds.items()}
    first = [np.unpackbits(np.frombuffer(v.as_py(), np.uint8), count=len(k)).astype(bool) for v, k in zip(batch.column("first"), got["low"], strict=True)]
    made = {c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in got.items()}
    made["key"] = made.pop("low").astype(np.uint32) | made.pop("high").astype(np.uint32) << 16
    made["first"] = np.concatenate(first) if first else np.zeros(0, bool)
    made["text"] = np.repeat(np.arange(len(made["uid"])), made.pop("rows"))
    return made


class _Part:
    """All bucket rows of one part of the keys, sorted by key and set size."""

    def __init__(self, least: float, crossing: bool, tile: int):
        self.least, self.crossing, self.tile = least, crossing, tile
        self.held: dict[str, list[np.ndarray]] = {c: [] for c in ("uid", "side", "size", "s0", "s1", "key", "text", "first")}
        self.texts = 0
        self.buffers = (np.empty((tile, tile), np.uint64), np.empty((tile, tile), np.uint8), np.empty((tile, tile), np.uint8), np.empty((tile, tile), bool))

    def add(self, batch: pa.RecordBatch) -> None:
        got = opened_blocks(batch)
        got["text"] = got["text"] + self.texts
        self.texts += len(got["uid"])
        for c in self.held:
            self.held[c].append(got[c])

    def pairs(self):
        if not self.texts:
            return
        h = {c: np.concatenate(v) for c, v in self.held.items()}
        self.held.clear()
        self.uid, self.side, self.size, self.s0, self.s1 = (h[c] for c in ("uid", "side", "size", "s0", "s1"))
        rank = np.empty(len(self.uid), np.int64)
        by_size = np.lexsort((self.uid, self.size))
        rank[by_size] = np.arange(len(by_size))
        # one sort by key and size; ties of size by uid, so the order is the same whatever order the blocks came in
        packed = h["key"].astype(np.uint64) << np.uint64(32) | rank[h["text"]].astype(np.uint64)
        order = np.argsort(packed)
        key, text, first = h["key"][order], h["text"][order], h["first"][order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(starts, len(key)))
        each = np.repeat(counts, counts)
        few = (each > 1) & (each <= 64)
        yield self._small(key[few], text[few], first[few])
        for s, n in zip(starts[counts > 64].tolist(), counts[counts > 64].tolist(), strict=True):
            yield from self._large(text[s : s + n], first[s : s + n])

    def _kept(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (apart <= radius(self.size[a].astype(np.int64), self.size[b].astype(np.int64), self.least)) & (self.size[a] >= np.ceil(self.least * self.size[b] - 1e-9))
        if self.crossing:
            ok &= (self.side[a] | self.side[b]) == 3
        return self.uid[a[ok]], self.uid[b[ok]]

    def _small(self, key: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All small buckets at once: each row against the d-th after it, as long as the key is the same."""
        i, d, xs, ys = np.flatnonzero(first), 0, [], []
        while len(i):
            d += 1
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            a, b = text[i], text[i + d]
            x, y = self._kept(a, b, np.bitwise_count(self.s0[a] ^ self.s0[b]).astype(np.int16) + np.bitwise_count(self.s1[a] ^ self.s1[b]))
            xs.append(x)
            ys.append(y)
        return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _large(self, text: np.ndarray, first: np.ndarray):
        """One large bucket, tile against tile; tiles whose set sizes differ beyond the radius are skipped."""
        s0, s1, size = self.s0[text], self.s1[text], self.size[text].astype(np.int64)
        for i in range(0, len(text), self.tile):
            rows = i + np.flatnonzero(first[i : i + self.tile])
            if not len(rows):
                continue
            x0, x1, largest, m = s0[rows][:, None], s1[rows][:, None], size[rows[-1]], len(rows)
            for j in range(i, len(text), self.tile):
                if largest < np.ceil(self.least * size[j] - 1e-9):
                    break
                end = min(j + self.tile, len(text))
                # buffers are kept: a tile's temporaries would cost more than its comparisons
                words, apart, other, near = (buffer[:m, : end - j] for buffer in self.buffers)
                np.bitwise_count(np.bitwise_xor(x0, s0[None, j:end], out=words), out=apart)
                np.bitwise_count(np.bitwise_xor(x1, s1[None, j:end], out=words), out=other)
                np.less_equal(np.add(apart, other, out=apart), radius(largest, size[end - 1], self.least), out=near)
                if near.any():
                    r, c = np.divmod(np.flatnonzero(near), end - j)
                    a, b = rows[r], j + c
                    later = b > a
                    yield self._kept(text[a[later]], text[b[later]], apart[r, c][later].astype(np.int64))


def candidates(blocks: DataFrame, parts: int, least: float = SIMILARITY, crossing: bool = False, tile: int = TILE) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts that share a rare piece and whose sketches lie within the radius.

    Each task holds the rows of one part of the keys, about ROWS_PER_PART whatever the corpus, as parts grow with it and
    common keys are dealt out to cells.  With ``crossing`` only pairs of side 1 and side 2 count.
    """

    def compare(batches):
        part = _Part(least, crossing, tile)
        for batch in batches:
            part.add(batch)
        held, n = [], 0
        for a, b in part.pairs():
            if len(a):
                held.append((np.minimum(a, b), np.maximum(a, b)))
                n += len(a)
            if n >= HELD:
                yield from given(held)
                held, n = [], 0
        if held:
            yield from given(held)

    def given(held):
        low, high = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) & (low < high)
        low, high = low[new], high[new]
        for i in range(0, len(low), 100_000):
            yield pa.RecordBatch.from_pydict({"a": low[i : i + 100_000], "b": high[i : i + 100_000]})

    return blocks.repartition(parts, "part").mapInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of uids whose texts are nearly the same, exactly."""

    def check(batches):
        for batch in batches:
            j = jaccard(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(j >= least - 1e-12))

    plain = texts.select("uid", "text")
    first = pairs.join(plain, pairs["a"] == plain["uid"]).select("a", "b", F.col("text").alias("text_a"))
    both = first.join(plain, first["b"] == plain["uid"])
    return both.select("a", "b", "text_a", "text").mapInArrow(check, "a long, b long")


def hashed_classes(rows: DataFrame, form: Column, within: list[str], also: list[str] | None = None) -> DataFrame:
    """(uid, text, ...) -> (uid, h1, h2, ...): 128 bits of the columns ``within`` and the consistent form, without rows whose form is empty; written once."""
    made = rows.withColumn("form", form).where(F.col("form") != "")
    return settle(made.select("uid", F.xxhash64(*within, "form").alias("h1"), F.xxhash64(F.lit(7), *within, "form").alias("h2"), *within, *(also or [])), "classes")


def representatives(hashed: DataFrame, *more: Column) -> DataFrame:
    """One row for each form: the smallest uid as ``rep``, combined on the map side, so a form with many copies isn't gathered."""
    return hashed.groupBy("h1", "h2").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies"), *more)


def near_classes(rows: DataFrame, reps: DataFrame, common: Commonness, least: float = SIMILARITY, crossing: bool = False) -> DataFrame:
    """Pairs (a, b) of representatives with nearly the same text.  ``reps``: rep and side; ``rows``: uid and text of all rows."""
    spark = rows.sparkSession
    texts = rows.select("uid", "text")
    chosen = texts.join(reps.select(F.col("rep").alias("uid"), "side"), "uid")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.texts * 24 // ROWS_PER_PART)
    found = candidates(bucket_blocks(chosen, common, least, parts, crossing), parts, least, crossing)
    # both joins read one and the same shuffle of the texts; representatives' texts written apart took more disk than they saved
    return verified(found, texts, least)
