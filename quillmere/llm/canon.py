"""One consistent form for texts that look the same (problem 6).

The text is exploded to positioned code points, each code point is looked up in a
decomposition and look-alike mapping, combining marks are ordered by class, the result
is recomposed, and the strings are rebuilt.  All of it happens inside an Arrow batch on
flat arrays: the mapping is the small side of the lookup and is built from the Unicode
database on each worker, so no row leaves its partition and nothing is shuffled.

Defined results: a null text stays null, an empty text stays empty; line breaks stay as
they are; every kind of space becomes one ordinary space, so the number of spaces still
counts; letter case, accents and other punctuation still count.
"""

from __future__ import annotations

import glob
import os
import string
import struct
import sys
import unicodedata
import zipfile
from functools import lru_cache

import numpy as np
import pandas as pd
import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Compatibility mappings that keep the look of a character.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<small>")

#: Beyond Unicode's table of confusable letters (below): letters that it lacks or that this mapping has to have where the
#: table can't be read, katakana with the shape of an ideograph, hyphens and minus signs of one shape, operators with the
#: shape of a punctuation mark, and radicals with the shape of an ideograph that Unicode doesn't map itself.
LOOK_ALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϹϲϳͿ" "АВЕЅІЈКМНОРСТХаеорсухѕіјԁһԛԝԚԜ" "エロカニハタトヘ" "‐−﹣" "∶∕⁄∗∼∣" "⺓⺠⺩⺬⺶⺻⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰",
        "ABEZHIKMNOPTYXoCcjJ" "ABESIJKMHOPCTXaeopcyxsijdhqwQW" "工口力二八夕卜へ" "---" "://*~|" "幺民王示羊聿虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙",
        strict=True,
    )
)


def confusable_table() -> dict[int, str]:
    """Unicode's table of confusable characters (UTS 39), code point -> prototype, as the ICU library in Spark's own folder of jars has it; empty if there is none."""
    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for jar in sorted(j for h in homes if h for j in glob.glob(os.path.join(h, "jars", "icu4j-*.jar"))):
        with zipfile.ZipFile(jar) as pack:
            name = next((n for n in pack.namelist() if n.endswith("confusables.cfu")), None)
            data = pack.read(name) if name else b""
        if not data:
            continue
        # a header of its own length, then offsets and lengths of the keys, the values and the strings, all big-endian
        body = data[int.from_bytes(data[:2], "big") :]
        key_at, keys, value_at, values, text_at, texts = struct.unpack(">6i", body[12:36])
        strings = np.frombuffer(body, ">u2", texts, text_at)
        table = {}
        for key, value in zip(np.frombuffer(body, ">u4", keys, key_at).tolist(), np.frombuffer(body, ">u2", values, value_at).tolist(), strict=True):
            units = (key >> 24) + 1  # one unit is the value itself, more are a place among the strings
            table[key & 0x1FFFFF] = chr(value) if units == 1 else strings[value : value + units].astype("<u2").tobytes().decode("utf-16-le")
        return table
    return {}


def confusable_letters() -> dict[str, str]:
    """Letters of all alphabets -> the letter that they look like: an ASCII letter of the same case if there is one, else the prototype.

    ASCII letters stay as they are, so 1, l and I or 0 and O are different; so do ideographs, kana and Hangul, and letters that
    Unicode decomposes or whose prototype is several characters.
    """
    table = confusable_table()
    ascii_of: dict[str, list[str]] = {}
    for c in string.ascii_letters:
        ascii_of.setdefault(table.get(ord(c), c), []).append(c)
    out = {}
    for cp, prototype in sorted(table.items()):
        c = chr(cp)
        if cp < 0x80 or 0x1100 <= cp < 0x1200 or 0x2E80 <= cp < 0xA000 or 0xA960 <= cp < 0xA980 or 0xAC00 <= cp < 0xD800 or cp >= 0x20000 or not unicodedata.category(c).startswith("L") or unicodedata.decomposition(c):
            continue
        known = ascii_of.get(prototype)
        if known:
            out[c] = next((x for x in known if x.isupper() == (unicodedata.category(c) == "Lu")), known[0])
        elif len(prototype) == 1 and unicodedata.category(prototype).startswith("L") and ord(prototype) >= 0x80 and prototype not in table:
            out[c] = prototype
    return out


def _ignorable(cp: int) -> bool:
    """Characters that leave no mark: format characters, joiners, variation selectors, fillers."""
    return cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp <= 0xE01EF or (unicodedata.category(chr(cp)) == "Cf")


@lru_cache(maxsize=1)
def tables() -> dict[str, object]:
    """The mapping as flat arrays: code point -> start and length in ``flat``, combining class, space flag, pairs to compose."""
    size = sys.maxunicode + 1
    cache: dict[int, tuple[int, ...]] = {}
    look = confusable_letters() | LOOK_ALIKES

    def full(cp: int) -> tuple[int, ...]:
        if cp not in cache:
            c = chr(cp)
            if _ignorable(cp):
                cache[cp] = ()
            elif unicodedata.category(c) == "Zs" or cp == 9:
                cache[cp] = (32,)
            elif c in look:
                cache[cp] = (ord(look[c]),)
            else:
                parts = unicodedata.decomposition(c).split()
                if parts and parts[0][0] == "<":
                    parts = parts[1:] if parts[0] in SAME_LOOK else []
                if parts:
                    cache[cp] = tuple(x for p in parts for x in full(int(p, 16)))
                else:
                    cache[cp] = (cp,)
        return cache[cp]

    count = np.ones(size, np.uint8)
    start = np.arange(size, dtype=np.int32)
    ccc = np.zeros(size, np.uint8)
    more: list[int] = []
    pairs: dict[tuple[int, int], int] = {}
    for cp in range(0x80, 0xE01F0):
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xF900 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000:
            continue  # ideographs, Hangul syllables, surrogates, private use: they stand for themselves
        c = chr(cp)
        ccc[cp] = unicodedata.combining(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            pairs[int(parts[0], 16), int(parts[1], 16)] = cp
        to = full(cp)
        if to != (cp,):
            start[cp] = size + len(more)
            count[cp] = len(to)
            more.extend(to)
    start[9], count[9] = 32, 1
    space = np.zeros(size, bool)
    for cp in range(0x3001):
        space[cp] = chr(cp).isspace()
    flat = np.concatenate([np.arange(size, dtype=np.uint32), np.array(more, np.uint32)])
    second = np.zeros(size, bool)
    second[[b for _, b in pairs]] = True
    second[0x1161:0x1176] = True
    second[0x11A8:0x11C3] = True
    return {"count": count, "start": start, "flat": flat, "ccc": ccc, "space": space, "pairs": pairs, "second": second | (ccc > 0)}


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and the length of each text."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def canonical_points(cps: np.ndarray, lens: np.ndarray, drop_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Consistent form of flat code points; with ``drop_space`` all white space is left out."""
    t = tables()
    row = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    n = t["count"][cps]
    if len(n) and n.min() == n.max() == 1:
        out = t["flat"][t["start"][cps]]
    else:
        n = n.astype(np.int64)
        first = np.cumsum(n) - n
        out = t["flat"][np.repeat(t["start"][cps] - first, n) + np.arange(int(n.sum()))]
        row = np.repeat(row, n)
    if len(out) and t["second"][out].any():
        out, row = _recompose(out, row, t)
    if drop_space:
        keep = ~t["space"][out]
        out, row = out[keep], row[keep]
    return out, np.bincount(row, minlength=len(lens)).astype(np.int64)


def _recompose(out: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Order each run of marks by class, then join starters with what follows them."""
    ccc, pairs = t["ccc"], t["pairs"]
    out = out.copy()
    marks = np.flatnonzero(ccc[out] > 0)
    if len(marks):
        runs = np.split(marks, np.flatnonzero((np.diff(marks) != 1) | (np.diff(row[marks]) != 0)) + 1)
        for run in runs:
            if len(run) > 1:
                part = out[run]
                out[run] = part[np.argsort(ccc[part], kind="stable")]
    gone = np.zeros(len(out), bool)
    starter, last_class, before = -1, 0, -2
    for i in np.flatnonzero(t["second"][out]).tolist():
        c = int(ccc[out[i]])
        if i != before + 1 or starter < 0:
            starter, last_class = i - 1, 0
            if starter < 0 or ccc[out[starter]]:
                starter = -1
        if starter >= 0 and row[starter] != row[i]:
            starter = -1
        before = i
        if starter >= 0 and (last_class < c or last_class == 0):
            a, b = int(out[starter]), int(out[i])
            made = pairs.get((a, b))
            if made is None and 0x1100 <= a < 0x1113 and 0x1161 <= b < 0x1176:
                made = 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
            if made is None and 0xAC00 <= a < 0xD7A4 and (a - 0xAC00) % 28 == 0 and 0x11A8 <= b < 0x11C3:
                made = a + b - 0x11A7
            if made is not None:
                out[starter] = made
                gone[i] = True
                continue
        last_class = c
        if c == 0:
            starter, last_class = i, 0
    return out[~gone], row[~gone]


def rebuild(cps: np.ndarray, lens: np.ndarray) -> list[str]:
    """Strings of flat code points."""
    whole = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(lens).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def canonical_texts(texts: list[str | None], drop_space: bool = False) -> list[str | None]:
    """Consistent form of each text; None stays None."""
    known = [x if x is not None else "" for x in texts]
    forms = rebuild(*canonical_points(*code_points(known), drop_space))
    return [None if x is None else f for x, f in zip(texts, forms, strict=True)]


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return pd.Series(canonical_texts([x if isinstance(x, str) else None for x in texts]), dtype=object)


@F.pandas_udf(StringType())
def _canonical_dense(texts: pd.Series) -> pd.Series:
    return pd.Series(canonical_texts([x if isinstance(x, str) else None for x in texts], True), dtype=object)


def canonical(text: Column) -> Column:
    """The consistent form of a text column."""
    return _canonical(text)


def canonical_dense(text: Column) -> Column:
    """The consistent form without any white space, as compared in problems 1, 2 and 5."""
    return _canonical_dense(text)
