"""Features of short texts for the near-duplicate operators, on flat arrays of code points.

Two texts are compared by their sets of distinct pieces of two adjacent characters.  Three
features speed that up:

* ``parity_sketch``: 128 bits, each the parity of the pieces hashed to it.  One piece in only
  one of two sets flips one bit, so the Hamming distance of two sketches never exceeds the
  number of pieces in which the sets differ: too great a distance rules a pair out for certain.
* ``fingerprints``: winnowed hashes of four adjacent characters.
* ``Commonness``: how often the corpus has a feature, by a count-min row of fixed width over all
  rows, so what every task gets to know of the corpus has one size.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator  # noqa: UP035

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.canon import canonical_points, canonical_texts, code_points

#: Texts handled at once; a chunk's row number takes 14 bits of a packed key.
CHUNK = 1 << 14
#: Width of the count-min row.
WIDTH = 1 << 18
#: A fingerprint held by less than this share of all texts counts as rare.
RARE = 0.0005
PIECE, WINDOW = 4, 2
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M1
    return x ^ (x >> np.uint64(31))


def dense_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the consistent forms without white space; null counts as empty."""
    return canonical_points(*code_points([x or "" for x in texts]), drop_space=True)


def bigrams(cps: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pieces of two characters: their row and their code, sorted by both.  At most CHUNK rows."""
    row = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
    wide = cps.astype(np.uint64)
    if len(wide) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    same = row[1:] == row[:-1]
    packed = (row[1:] << np.uint64(42) | wide[:-1] << np.uint64(21) | wide[1:])[same]
    packed.sort()
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    return (packed >> np.uint64(42)).astype(np.int64), packed & np.uint64((1 << 42) - 1)


def hashed_bigrams(cps: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct pieces."""
    row, code = bigrams(cps, lens)
    return row, mix(code + np.uint64(1))


def parity_sketch(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit words for each of n rows."""
    sketch = np.zeros((n, 2), np.uint64)
    if len(row):
        h = mix(code + np.uint64(1))
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        bit = np.uint64(1) << (h & np.uint64(63))
        for w in (0, 1):
            here = np.where((h >> np.uint64(6)) & np.uint64(1) == np.uint64(w), bit, np.uint64(0))
            sketch[row[first], w] = np.bitwise_xor.reduceat(here, first)
    return sketch


def fingerprints(cps: np.ndarray, lens: np.ndarray, k: int = PIECE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of k adjacent characters: the smallest of each ``window`` neighbours.  A shorter text has one, of the whole."""
    n = len(lens)
    row = np.repeat(np.arange(n), lens)
    at = np.arange(len(cps)) - np.repeat(np.cumsum(lens) - lens, lens)
    left = np.repeat(lens, lens) - at
    h = np.zeros(len(cps), np.uint64)
    for i in range(k):
        here = np.zeros(len(cps), np.uint64)
        here[: len(cps) - i] = cps[i:]
        h = mix(h + np.where(left > i, here + np.uint64(1), np.uint64(0)) * M1)
    whole = (left >= k) | (at == 0)
    row, h = row[whole], h[whole]
    for _ in range(window - 1):
        if len(h) > 1:
            after = np.concatenate([row[1:] == row[:-1], [False]])
            # the last hash of a text has no neighbour: it stays only if it is the only one
            keep = after | np.concatenate([[True], ~after[:-1]])
            h = np.where(after, np.minimum(h, np.concatenate([h[1:], h[-1:]])), h)[keep]
            row = row[keep]
    # neighbours often have the same smallest hash; what repeats further apart stays
    if len(h):
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
        row, h = row[new], h[new]
    return row, h


def _arrays(batch: pa.RecordBatch, text: int) -> list[list[str | None]]:
    values = batch.column(text).to_pylist()
    return [values[i : i + CHUNK] for i in range(0, len(values), CHUNK)]


class Commonness:
    """How often fingerprints occur, as a count-min row of bytes on a logarithmic scale; 256 KB whatever the corpus."""

    def __init__(self, classes: bytes, texts: int, rare: float = RARE):
        self.classes, self.texts, self.rare = classes, texts, rare

    def of(self, h: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.classes, np.uint8)[(h & np.uint64(WIDTH - 1)).astype(np.int64)]

    def cells(self, kind: np.ndarray, cell: int) -> np.ndarray:
        """Into how many cells of at most ``cell`` rows the rows of a feature of this class are dealt; 1 for rare ones."""
        held = np.where(kind > 0, 2.0 ** (kind / 4.0) * self.rare * self.texts, 0)
        return np.clip(np.ceil(held / cell), 1, 1 << 20).astype(np.int64)

    @staticmethod
    def scale(counts: np.ndarray, texts: int, rare: float = RARE) -> np.ndarray:
        share = counts / max(1.0, rare * texts)
        return np.where(share <= 1, 0, np.clip(1 + 4 * np.log2(np.maximum(share, 1)), 1, 63)).astype(np.uint8)

    @classmethod
    def fit(cls, df: DataFrame, text: str, feature: Callable = None, rare: float = RARE) -> Commonness:
        """Counts of ``feature`` (fingerprints unless given) over all rows of ``df``: each task adds up one row of fixed width, and slices of these rows are added in a shuffle."""
        pieces = 16
        step = WIDTH // pieces
        feature = feature or fingerprints

        def count(batches):
            total, seen = np.zeros(WIDTH, np.int64), 0
            for batch in batches:
                for texts in _arrays(batch, 0):
                    cps, lens = dense_points(texts)
                    _, h = feature(cps, lens)
                    total += np.bincount((h & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
                    seen += int((lens > 0).sum())
            if seen:
                yield pa.RecordBatch.from_pydict({"part": pa.array(range(pieces), pa.int32()), "texts": pa.array([seen] * pieces, pa.int64()), "counts": pa.array([total[i * step : (i + 1) * step].astype("<i8").tobytes() for i in range(pieces)], pa.binary())})

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(step, np.int64), 0
            for batch in batches:
                for c, t in zip(batch.column("counts"), batch.column("texts"), strict=True):
                    total += np.frombuffer(c.as_py(), "<i8")
                    seen += t.as_py()
            yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "texts": pa.array([seen], pa.int64()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

        schema = "part int, texts long, counts binary"
        rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()  # 16 rows, 2 MB in all
        if not rows:
            return cls(bytes(WIDTH), 0, rare)
        counts = np.concatenate([np.frombuffer(bytes(r["counts"]), "<i8") for r in sorted(rows, key=lambda r: r["part"])])
        return cls(cls.scale(counts, rows[0]["texts"], rare).tobytes(), rows[0]["texts"], rare)


def jaccard(a: list[str], b: list[str]) -> np.ndarray:
    """Similarity of the texts at the same place of both lists, exactly, by sets of two adjacent characters.

    0 if either has none, but 1 if both are one and the same character.
    """
    out = []
    for i in range(0, len(a), CHUNK // 2):
        x, y = a[i : i + CHUNK // 2], b[i : i + CHUNK // 2]
        n = len(x)
        row, code = bigrams(*dense_points([*x, *y]))
        size = np.bincount(row, minlength=2 * n)
        packed = (row % n).astype(np.uint64) << np.uint64(42) | code
        packed.sort()
        twice = packed[1:][packed[1:] == packed[:-1]] >> np.uint64(42) if len(packed) else packed
        both = np.bincount(twice.astype(np.int64), minlength=n)
        alike = both / np.maximum(1, size[:n] + size[n:] - both)
        for i in np.flatnonzero((size[:n] == 0) & (size[n:] == 0)).tolist():
            p, q = canonical_texts([x[i], y[i]], drop_space=True)
            alike[i] = float(bool(p) and p == q)
        out.append(alike)
    return np.concatenate(out) if out else np.zeros(0)
