"""Encoding whole corpora with a public byte-level BPE vocabulary (problem 7).

A text is cut into pieces by the vocabulary's pattern, and each distinct piece is encoded once per worker.
The bytes of a piece, written as Latin-1 characters, are matched against an automaton of all tokens; the
encoder starts with the longest token and backtracks to shorter ones wherever two neighbours could not
stand side by side in the result of the merges.  Which tokens may be neighbours is memoised.  A sequence
in which all neighbours are compatible is the one that the merges give, so the result is exact, and each
position is given up at most once, so the time is linear.

Defined results: an empty and a null text have an empty list; strings of special tokens are ordinary text;
lone surrogates, which Arrow can't hold, don't occur; very long texts are encoded whole; repeated texts give
equal lists; other columns aren't read.
"""

from __future__ import annotations

import base64
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies unless a caller says otherwise, and the pattern that its pieces follow.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces and neighbours remembered per worker; beyond that the memory is emptied, which costs time only.
MEMORY = 600_000


class BytePairs:
    """An exact encoder for one vocabulary; tokens are ranked in the order of their merges."""

    _made: dict[str, BytePairs] = {}

    @classmethod
    def of(cls, path: str) -> BytePairs:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.find = regex.compile(PATTERN).findall
        size = max(ranks.values()) + 1
        self.length = [0] * size
        self.shorter = [-1] * size
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[int, int] = {}
        self.beside: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        matcher = ahocorasick.Automaton()
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.length[rank] = len(word)
            matcher.add_word(word, (len(word), rank))
            for cut in range(len(word) - 1, 0, -1):
                if (known := ranks.get(word[:cut])) is not None:
                    self.shorter[rank] = known
                    break
            # the last merge of a token: the cut whose parts are older tokens that may stand side by side
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._compatible(a, b):
                    self.halves[rank] = (a, b)
                    self.merged[a << 20 | b] = rank
                    break
        matcher.make_automaton()
        self.matches = matcher.iter
        self.beside.clear()  # while the table grew, some answers were early

    def _compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b may be neighbours: no merge across their border comes before those that made them.

        The merges of a and b are undone one by one, the latest first, along the border.  If at some point the two
        parts that meet there have a merge older than the one just undone, it would have been made instead.
        """
        merged, halves = self.merged, self.halves
        bound = 1 << 30
        while True:
            across = merged.get(a << 20 | b)
            if across is not None and across < bound:
                return False
            undo_left = a > b
            left, right = halves[a][1], halves[b][0]
            if undo_left and left == a:
                undo_left = False
            elif not undo_left and right == b:
                if left == a:
                    return True
                undo_left = True
            if undo_left:
                bound, a = a, left
            elif right == b:
                return True
            else:
                bound, b = b + 1, right

    def encode_piece(self, piece: str) -> list[int]:
        """Tokens of one piece, given as Latin-1."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        n = len(piece)
        longest = [-1] * n
        width = [0] * n
        for end, (size, rank) in self.matches(piece):
            start = end + 1 - size
            if size > width[start]:
                width[start] = size
                longest[start] = rank
        length, shorter, beside, compatible = self.length, self.shorter, self.beside, self._compatible
        out: list[int] = []
        open_at = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0]
        while True:
            if open_at[at + length[token]]:
                if out:
                    pair = out[-1] << 20 | token
                    ok = beside.get(pair)
                    if ok is None:
                        ok = beside[pair] = compatible(out[-1], token)
                else:
                    ok = True
                if ok:
                    out.append(token)
                    at += length[token]
                    if at == n:
                        return out
                    token = longest[at]
                    continue
            token_next = shorter[token]
            if token_next >= 0:
                token = token_next
            else:  # nothing fits here: this position is given up, and the token before it becomes shorter
                open_at[at] = 0
                token = out.pop()
                at -= length[token]

    def encode_bytes(self, text: str) -> bytes:
        """Tokens of a text as 32-bit integers one after another."""
        pieces = self.pieces
        found = self.find(text)
        try:
            return b"".join([pieces[x] for x in found])
        except KeyError:
            for x in found:
                if x not in pieces:
                    pieces[x] = np.array(self.encode_piece(x.encode("utf-8").decode("latin-1")), "<i4").tobytes()
            whole = b"".join([pieces[x] for x in found])
            if len(pieces) > MEMORY:
                pieces.clear()
            if len(self.beside) > 4 * MEMORY:
                self.beside.clear()
            return whole


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) for each row; no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def encode(batches):
        coder = BytePairs.of(vocabulary)
        for batch in batches:
            parts = [coder.encode_bytes(x) if x else b"" for x in batch.column(1).to_pylist()]
            # a list column's offsets have 32 bits; batches are far below, but a batch of very long texts is cut
            start = 0
            while start < len(parts):
                stop, total = start, 0
                while stop < len(parts) and (stop == start or total + len(parts[stop]) < 1 << 26):
                    total += len(parts[stop])
                    stop += 1
                offsets = np.cumsum([0, *(len(p) // 4 for p in parts[start:stop])]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts[start:stop]))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[key, "ids"])
                start = stop

    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of ``df`` but the text, with ``n_tokens``; no shuffle."""
    others = [c for c in df.columns if c != text]
    schema = ", ".join(chain((f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others), ["n_tokens long"]))

    def encode(batches):
        coder = BytePairs.of(vocabulary)
        for batch in batches:
            n = [len(coder.encode_bytes(x)) // 4 if x else 0 for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(n, pa.int64())], names=[*others, "n_tokens"])

    return df.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(encode, schema)
