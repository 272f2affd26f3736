"""Template residue, filler, error pages and script notices (problem 9): character n-gram models and likelihood-ratio windows.

Natural prose is modelled by the n-grams of the whole corpus, counted in tables by every task and added up: in how many
different texts each is, where a text weighs by its length up to PAGE characters, so neither copies nor length give a text
weight, and the wording of short pages doesn't become prose.  Unfilled fields, filler, random letters and notices are
modelled on material made by rule (``residue_seeds``), no line of which comes from a table.  For every character the
logarithm of the likelihood ratio of each kind against prose is averaged over a window; windows above a threshold localise
residue.  Unfilled fields are looked for once more in the shape of the text, where every run of letters, of ideographs or
of digits is one sign, so that a field counts whatever its name.  A document is excluded if a sentence that hasn't the
corpus's own wording has an unfilled field, or if filler and notices cover most of its body, where titles, navigation and
other lines without a sentence are not body.  Prose must have wording that the corpus has often, and a document without
any prose is excluded for one line that reads like a notice, so messages that no material shows are found as well.

Defined results: null, empty and blank texts are no case; code blocks are the document's own content; long texts
are scored whole; copies are scored alike; an empty table gives no rows; other columns aren't read.  Wording is told from
pieces that FAMILIAR of all texts have, so in a corpus of under some 700 texts a text's own weight makes its pieces familiar, and
only the material and, for fields, wording that several texts share count.
"""

from __future__ import annotations

from typing import Iterator  # noqa: UP035

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.canon import canonical_points, code_points
from quillmere.llm.grams import mix
from quillmere.llm.residue_seeds import material

#: Lengths of the n-grams and width of each count table.
ORDERS = (2, 3, 4)  # each made of the one before and the next character
WIDTH = 1 << 18
KINDS = ("field", "slot", "filler", "noise", "notice")
#: Lengths of the n-grams of shapes and width of their tables; shapes have few signs.
SHAPES, SHAPE_WIDTH = (3, 4, 5), 1 << 16
#: Characters in a window, and the mean log-likelihood ratio from which a window is residue.
WINDOW = 8
LEAST = 0.6
#: Share of a sentence, and of a body, that residue must cover.
SENTENCE, BODY = 0.6, 0.5
#: Share of a sentence that must read like a letter with fields, and the ratio from which a window is an unfilled one.
LETTER, SLOT = 0.2, 2.0
#: A sentence that talks about a template has more than a share OTHER of windows that are prose by a ratio of TOLD.
TOLD, OTHER = 1.0, 0.3
#: Ratio from which a place has the shape of an unfilled field, and the share of the corpus's own wording from which a sentence tells of it.
SIGN, TELLS = 2.5, 0.6
#: Additive smoothing of the counts, for material, prose and shapes; and the bounds of a ratio.  The material is a small sample,
#: so that it lacks an n-gram counts less than that it has it.
ALPHA, BETA, GAMMA = 0.02, 0.4, 0.5
LOW, HIGH = -3, 6
#: A text weighs as many parts of PARTS as it has characters of PAGE, at most all.
PAGE, PARTS = 2000, 64
#: Longer pieces tell which wording is the corpus's own: those that texts of such a share of all weight have are familiar, and a
#: prose sentence has at least a share OWN of them.
LONG, FAMILIAR, OWN = 6, 0.0015, 0.45
#: In a document without prose, a line of which less than this share of pieces of four characters is in so many documents
#: is no title or navigation of this corpus either.
SHORT, KNOWN, STRANGE = 4, 0.003, 0.35
#: Cells of the piece tables for each piece that may be familiar: these are at most the mean length of a text / FAMILIAR.
ROOM = 2
SLICES = 16
#: Characters scored at once.
CHARS = 300_000


def _after(x: np.ndarray, by: int) -> np.ndarray:
    """Each value moved on by so many places, zeros before."""
    out = np.zeros_like(x)
    out[by:] = x[: len(x) - by]
    return out


def simplified(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points for the models: consistent form, Latin in lower case, and every number or date as one 0."""
    cps, lens = canonical_points(*code_points(texts), drop_space=False)
    cps = np.where((cps >= 65) & (cps <= 90), cps + np.uint32(32), cps)
    digit = (cps >= 48) & (cps <= 57)
    cps = np.where(digit, np.uint32(48), cps)
    space = cps == 32
    unit = (cps == ord("年")) | (cps == ord("月")) | (cps == ord("日"))
    unit &= _after(digit, 1) | (_after(space, 1) & _after(digit, 2))
    body = digit | unit
    # signs between digits, and a space before or after a unit
    between = (cps == ord("-")) | (cps == ord(":")) | (cps == ord(".")) | (cps == ord(","))
    before = np.concatenate([digit[1:], [False]]) if len(cps) else digit
    next_unit = np.concatenate([unit[1:], [False]]) if len(cps) else unit
    body |= (between & _after(digit, 1) & before) | (space & ((_after(digit, 1) & next_unit) | (_after(unit, 1) & before)))
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    keep = ~(body & _after(body, 1) & (doc == _after(doc, 1)))
    return np.where(body, np.uint32(48), cps)[keep], np.bincount(doc[keep], minlength=len(lens)).astype(np.int64)


def grams(cps: np.ndarray, widths: tuple[int, int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each character the table cells of the n-grams that end there, by order, and of the pieces of LONG and SHORT characters; one mix for each."""
    wide = cps.astype(np.uint64) + np.uint64(1)
    step = np.uint64(0x9E3779B97F4A7C15)
    made = [mix(wide)]
    for _ in ORDERS:
        made.append(mix(_after(made[-1], 1) * step + wide))
    long = mix(_after(made[3], 2) * step + made[1])  # four characters and the two after them
    return [(h & np.uint64(WIDTH - 1)).astype(np.int32) for h in made[1:]], [(h & np.uint64(w - 1)).astype(np.int32) for h, w in zip((long, made[SHORT - 1]), widths, strict=True)]


def shapes(cps: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of simplified texts, their number in each text and where each begins: runs of Latin letters, of ideographs,
    of underscores and of two or more x are one sign each."""
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    before = _after(cps, 1) == cps
    beside = before | np.concatenate([before[1:], [False]]) if len(cps) else before
    out = np.where((cps >= 97) & (cps <= 122) | (cps >= 0xC0) & (cps < 0x250), np.uint32(97), cps)
    out = np.where((cps >= 0x3400) & (cps < 0xA000), np.uint32(0x4E00), out)
    out = np.where(((cps == 120) | (cps == 0xD7)) & beside, np.uint32(120), out)
    run = (out == 97) | (out == 0x4E00) | (out == 120) | (out == 95)
    keep = ~(run & (out == _after(out, 1)) & (doc == _after(doc, 1)))
    return out[keep], np.bincount(doc[keep], minlength=len(lens)).astype(np.int64), np.flatnonzero(keep)


def shape_grams(signs: np.ndarray) -> list[np.ndarray]:
    """For each sign the table cells of the n-grams of shapes that end there."""
    wide = signs.astype(np.uint64) + np.uint64(1)
    made = [mix(wide)]
    for _ in range(SHAPES[-1] - 1):
        made.append(mix(_after(made[-1], 1) * np.uint64(0x9E3779B97F4A7C15) + wide))
    return [(made[k - 1] & np.uint64(SHAPE_WIDTH - 1)).astype(np.int32) for k in SHAPES]


def apart(texts: list[str]) -> list[str]:
    """Texts with so many line breaks before each that no n-gram reaches into the text before, whatever stands there."""
    return ["\n" * max(*ORDERS, *SHAPES, LONG) + x + "\n" for x in texts]


def counted(texts: list[str]) -> np.ndarray:
    """Counts of the n-grams of lines of material, one row for each order."""
    cps, _ = simplified(apart(texts))
    return np.stack([np.bincount(g, minlength=WIDTH) for g in grams(cps, (2, 2))[0]])


def counted_shapes(texts: list[str]) -> np.ndarray:
    """In how many lines of material each n-gram of shapes is, one row for each order."""
    signs, lens, _ = shapes(*simplified(apart(texts)))
    return np.stack([_holders(g, lens, np.ones(len(lens), np.int64), SHAPE_WIDTH) for g in shape_grams(signs)])


def weights(lens: np.ndarray) -> np.ndarray:
    """What each text counts, by its length: from 1 to PARTS."""
    return np.minimum(PARTS, -(-lens * PARTS // PAGE)).astype(np.int64)


def held(forms: list[str], widths: tuple[int, int]) -> tuple[list[np.ndarray], int]:
    """Weight of the simplified texts that have each n-gram, one table for each order, each n-gram of shapes, and each piece, one table for each length; and of all."""
    cps, lens = code_points(apart(forms))
    w = weights(lens)
    cells, long = grams(cps, widths)
    signs, short, _ = shapes(cps, lens)
    made = [_holders(g, lens, w, WIDTH) for g in cells] + [_holders(g, short, w, SHAPE_WIDTH) for g in shape_grams(signs)]
    return made + [_holders(p, lens, w, width) for p, width in zip(long, widths, strict=True)], int(w.sum())


def _holders(cells: np.ndarray, lens: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """Weight of the texts that have each cell: a text counts once, however often it has the cell, so no long text outweighs the others."""
    packed = np.repeat(np.arange(len(lens), dtype=np.uint64), lens) * np.uint64(width) | cells.astype(np.uint64)
    packed.sort()
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    return np.bincount((packed & np.uint64(width - 1)).astype(np.int64), weights=weight[(packed // np.uint64(width)).astype(np.int64)], minlength=width).astype(np.int64)


def distinct_forms(docs: DataFrame, text: str) -> DataFrame:
    """(form): the simplified texts, each once, so a page with many copies weighs as one; found by hash, combined on the map side."""

    def simplify(batches):
        for batch in batches:
            for part in _parts([x for x in batch.column(0).to_pylist() if x]):
                cps, lens = simplified(part)
                ends = np.cumsum(lens)
                whole = cps.astype("<u4").tobytes().decode("utf-32-le")
                yield pa.RecordBatch.from_pydict({"form": pa.array([whole[e - n : e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)], pa.string())})

    forms = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(simplify, "form string")
    keys = (F.xxhash64("form").alias("h1"), F.xxhash64(F.lit(7), "form").alias("h2"))
    return forms.where("form <> ''").select(*keys, "form").groupBy("h1", "h2").agg(F.first("form").alias("form")).select("form")


def often(counts: np.ndarray, least: float) -> np.ndarray:
    """Which cells of a piece table hold a weight of ``least`` or more beyond what falls into every cell by chance."""
    usual = counts[counts < least]
    return counts >= least + (usual.mean() if len(usual) else 0.0)


class ResidueModel:
    """Log-likelihood ratios of each kind against prose, and which pieces are familiar.

    Tables of one fixed size (some 20 MB), and three of marks whose width follows the mean length of the texts, not their number.
    """

    def __init__(self, prose: np.ndarray, shape: np.ndarray, familiar: np.ndarray, shared: np.ndarray, known: np.ndarray, lines: dict[str, list[str]] | None = None):
        self.familiar, self.shared, self.known = familiar, shared, known
        lines = lines or material()
        share = {}
        for kind in ("field", "filled", "filler", "noise", "notice"):
            c = counted(lines[kind])
            share[kind] = (c + ALPHA) / (c.sum(1, keepdims=True) + ALPHA * WIDTH)
        filled = share.pop("filled")
        common = (prose + BETA) / (prose.sum(1, keepdims=True) + BETA * WIDTH)
        ratio = {kind: np.clip(np.log(s / common), LOW, HIGH) for kind, s in share.items()}
        # what only an unfilled letter has: against letters of the same wording that are filled, and against prose
        ratio["slot"] = np.clip(np.log(share["field"] / np.maximum(filled, common)), -HIGH, HIGH)
        # the kinds of one cell lie side by side, so a character takes one lookup for each order
        self.table = [np.ascontiguousarray(np.stack([ratio[k][i] for k in KINDS], axis=1) / len(ORDERS), dtype=np.float32) for i in range(len(ORDERS))]
        signs, plain, usual = ((c + GAMMA) / (c.sum(1, keepdims=True) + GAMMA * 2000) for c in (counted_shapes(lines["signs"]), counted_shapes(lines["filled"]), shape))
        self.sign = (np.clip(np.log(signs / np.maximum(plain, usual)), -HIGH, HIGH) / len(SHAPES)).astype(np.float32)

    @staticmethod
    def widths(mean: float) -> tuple[int, int]:
        """Cells of the two piece tables for texts of so many characters in the mean: powers of two up to 2^26."""
        return tuple(1 << int(np.clip(np.ceil(np.log2(max(1.0, ROOM * mean / least))), 18, 26)) for least in (FAMILIAR, KNOWN))

    @classmethod
    def fit(cls, docs: DataFrame, text: str, lines: dict[str, list[str]] | None = None) -> ResidueModel:
        """In how many different documents each n-gram and piece is: one set of tables per task, slices of them added in a shuffle."""
        mean = docs.select(F.avg(F.length(F.col(text).cast("string"))).alias("m")).where("m is not null").collect()  # one row
        widths = cls.widths(mean[0]["m"] if mean else 0.0)
        sizes = [WIDTH] * len(ORDERS) + [SHAPE_WIDTH] * len(SHAPES) + list(widths)
        steps = [w // SLICES for w in sizes]
        marks = np.cumsum([0, *steps])
        marked = ("familiar", "shared", "known")

        def count(batches):
            total, seen = [np.zeros(w, np.int64) for w in sizes], 0
            for batch in batches:
                for part in _parts(batch.column(0).to_pylist()):
                    mine, weight = held(part, widths)
                    for t, m in zip(total, mine, strict=True):
                        t += m
                    seen += weight
            if seen:
                for i in range(SLICES):
                    flat = np.concatenate([t[i * k : (i + 1) * k] for t, k in zip(total, steps, strict=True)])
                    at = np.flatnonzero(flat)
                    data = at.astype("<u4").tobytes() + flat[at].astype("<i8").tobytes()
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "weight": pa.array([seen], pa.int64()), "counts": pa.array([data], pa.binary())})

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(marks[-1], np.int64), 0
            for batch in batches:
                for c, w in zip(batch.column("counts"), batch.column("weight"), strict=True):
                    data = c.as_py()
                    n = len(data) // 12
                    total[np.frombuffer(data, "<u4", n)] += np.frombuffer(data, "<i8", n, 4 * n)
                    seen += w.as_py()
            fixed = total[: marks[-3]].astype("<i8").tobytes()
            bits = [np.packbits(often(total[marks[i] : marks[i + 1]], least)).tobytes() for i, least in ((-3, FAMILIAR * seen), (-3, max(FAMILIAR * seen, PARTS + 1)), (-2, KNOWN * seen))]
            yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([fixed], pa.binary()), **{name: pa.array([b], pa.binary()) for name, b in zip(marked, bits, strict=True)}})

        rows = distinct_forms(docs, text).mapInArrow(count, "slice int, weight long, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary, familiar binary, shared binary, known binary")
        total = [np.zeros(w, np.int64) for w in sizes[:-2]]
        pieces = [np.zeros(w, bool) for w in (widths[0], *widths)]
        for r in rows.toLocalIterator():  # 16 rows, some 8 MB in all, one at a time
            i = r["slice"]
            flat = np.frombuffer(bytes(r["counts"]), "<i8")
            for t, k, at in zip(total, steps, marks, strict=False):
                t[i * k : (i + 1) * k] = flat[at : at + k]
            for b, k, name in zip(pieces, (steps[-2], *steps[-2:]), marked, strict=True):
                b[i * k : (i + 1) * k] = np.unpackbits(np.frombuffer(bytes(r[name]), np.uint8), count=k).astype(bool)
        return cls(np.stack(total[: len(ORDERS)]), np.stack(total[len(ORDERS) :]), *pieces, lines)

    def judge(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Of each text: sentences that are template residue, characters of filler and notices, characters of prose sentences,
        and lines that read more like filler or a notice than like the corpus, or unlike its titles and navigation."""
        n = len(texts)
        cps, lens = simplified(apart(texts))
        doc = np.repeat(np.arange(n), lens)
        if not len(cps):
            return {k: np.zeros(n, np.int64) for k in ("field", "waste", "prose", "odd")}
        cells, long = grams(cps, (len(self.familiar), len(self.known)))
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        # sentences end at line breaks, at full stops of either script, and at marks of question or exclamation
        ends = np.isin(cps, np.array([ord(c) for c in "\n\r。!?…"], np.uint32))
        after_dot = (cps == ord(".")) & np.concatenate([np.isin(cps[1:], np.array([32, 10, 13], np.uint32)) | (doc[1:] != doc[:-1]), [True]])
        begins = first | np.concatenate([[False], (ends | after_dot)[:-1]])
        seg = np.cumsum(begins) - 1
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(cps)))
        fence = np.zeros(len(cps), np.int64)
        tick = cps == ord("`")
        fence[2:] = tick[2:] & tick[1:-1] & tick[:-2]
        if fence.any():
            marks = np.cumsum(fence)
            marks -= np.repeat((marks - fence)[first.nonzero()[0]], lens[lens > 0])
            code = marks % 2 == 1
        else:
            code = np.zeros(len(cps), bool)
        blank = (cps == 32) | (cps == 9) | (cps == 10) | (cps == 13)
        solid = np.add.reduceat((~blank).astype(np.int64), start)
        each = self.table[0][cells[0]]
        for i in range(1, len(ORDERS)):
            each += self.table[i][cells[i]]
        at = np.arange(len(cps))
        low = np.maximum(at - WINDOW // 2, start[seg])
        high = np.minimum(at + WINDOW - WINDOW // 2, start[seg] + size[seg])
        width = np.maximum(1, high - low)
        score = {}
        for i, kind in enumerate(KINDS):
            total = np.concatenate([[0.0], np.cumsum(each[:, i], dtype=np.float64)])
            score[kind] = (total[high] - total[low]) / width
        best = np.maximum(np.maximum(score["filler"], score["noise"]), score["notice"])
        free = ~blank & ~code
        waste = np.add.reduceat(((best > LEAST) & free).astype(np.int64), start)
        field = np.add.reduceat(((score["field"] > LEAST) & free).astype(np.int64), start)
        in_code = np.add.reduceat(code.astype(np.int64), start) > 0
        last = start + size - 1
        # the long pieces that lie inside a sentence, and how many of them the corpus has often
        inside = np.arange(len(cps)) - start[seg] >= LONG - 1
        own = np.add.reduceat((inside & self.familiar[long[0]]).astype(np.int64), start)
        own_share = own / np.maximum(1, size - LONG + 1)
        shared_share = np.add.reduceat((inside & self.shared[long[0]]).astype(np.int64), start) / np.maximum(1, size - LONG + 1)
        within = np.arange(len(cps)) - start[seg] >= SHORT - 1
        known_share = np.add.reduceat((within & self.known[long[1]]).astype(np.int64), start) / np.maximum(1, size - SHORT + 1)
        mean = np.add.reduceat(np.where(free, best, 0.0), start) / np.maximum(1, solid)
        # a prose sentence ends in a full stop, has the corpus's own wording and is no waste
        stop = np.isin(cps[last], np.array([ord(c) for c in "。."], np.uint32)) | np.isin(cps[np.maximum(last - 1, start)], np.array([ord(c) for c in "。."], np.uint32))
        is_waste = (waste >= SENTENCE * solid) & (solid > 0)
        slot = np.maximum.reduceat(np.where(free, score["slot"], -9), start)
        told = np.add.reduceat(((score["field"] < -TOLD) & free).astype(np.int64), start)
        # the same in the shape of the text
        signs, _, where = shapes(cps, lens)
        from_sign = np.searchsorted(where, start)
        whole = np.arange(len(signs)) - from_sign[seg[where]] >= 1
        likely = sum(self.sign[i][g] for i, g in enumerate(shape_grams(signs)))
        sign = np.maximum.reduceat(np.where(whole & free[where], likely, -HIGH), np.minimum(from_sign, max(0, len(signs) - 1)))
        is_field = ((field >= LETTER * solid) & (told <= OTHER * solid) & (slot > SLOT)) | ((sign > SIGN) & (shared_share < TELLS))
        is_field &= (solid >= 4) & ~in_code
        is_prose = ~is_waste & ~is_field & ((stop & (solid >= LONG) & (own_share >= OWN)) | (in_code & (solid > 0)))
        of = doc[start]
        return {
            "field": np.bincount(of, is_field, n).astype(np.int64),
            "waste": np.bincount(of, np.where(is_waste, solid, 0), n).astype(np.int64),
            "prose": np.bincount(of, np.where(is_prose, solid, 0), n).astype(np.int64),
            "odd": np.bincount(of, ~is_prose & (((mean > 0) & (solid >= 3) & (own_share < OWN)) | ((known_share < STRANGE) & (solid >= LONG))), n).astype(np.int64),
        }


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Lists of whole texts of about CHARS characters."""
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size >= CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def residue_documents(docs: DataFrame, key: str, text: str, lines: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, field sentences, waste and prose characters) of the documents that are residue."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(ResidueModel.fit(docs, text, lines))  # some 20 MB, whatever the number of texts
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            done = 0
            for part in _parts(texts):
                j = model.value.judge(part)
                waste, prose = j["waste"], j["prose"]
                # without any prose one line that is like a notice is enough, so notices of unknown wording are found too
                hit = (j["field"] > 0) | ((waste > 0) & (waste >= BODY * (waste + prose))) | ((prose == 0) & (j["odd"] > 0))
                out = pa.RecordBatch.from_arrays([keys.slice(done, len(part)), *(pa.array(j[c], pa.int64()) for c in ("field", "waste", "prose"))], names=[key, "field_sentences", "waste_chars", "prose_chars"])
                yield out.filter(pa.array(hit))
                done += len(part)

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(judge, f"`{key}` {kind}, field_sentences long, waste_chars long, prose_chars long")
