import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import canon, neartext
from quillmere.llm.crosssplit import cross_split
from quillmere.llm.grams import Commonness, bigrams, fingerprints, hashed_bigrams, jaccard, parity_sketch
from quillmere.llm.history import History, across, already_accepted, bloom_bits, bloom_has, level_of
from quillmere.llm.neardup import groups, near_duplicates, row_pairs

PARTS = ["统计华东片区已完成的订单", "查一下合同HT482334走到哪一步", "时间大约2026-05-28 10:20", "有出入就对照FP709379", "结果发给外勤工程师就行", "给朗霖试点排一个碰头会", "核一核昱闳试点的到期日", "别按骏翡计划的旧表", "只看西北不看华南", "货在绍兴由嵘蒹霖园艺代收", "序号尾数是73E5034别认错", "对应的仓库在泉州编号E4424"]


def corpus(n, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.45 or not out:
            body = "，".join(rng.sample(PARTS, 3)) + str(rng.randint(0, 999999))
        else:
            body = rng.choice(out) or "空"
            if kind < 0.6:
                at = rng.randrange(len(body))
                body = body[:at] + rng.choice("急请的了") + body[at:]
            elif kind < 0.75:
                cut = body.split("，")
                rng.shuffle(cut)
                body = "，".join(cut)
            elif kind < 0.85:
                body = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in body)
        out.append(body)
    return [*out, None, "", " ", "​", "a", "ａ", "ab", "ab ", "aba", "b", "x" * 3000, "x" * 3001, "长" * 50 + "文" * 4000]


def grams(text):
    s = canon.canonical_texts([text or ""], True)[0]
    return s, {s[i : i + 2] for i in range(len(s) - 1)}


def near(a, b, least=0.7):
    (s, x), (t, y) = a, b
    if not s or not t:
        return False
    return s == t or (bool(x and y) and len(x & y) / len(x | y) >= least)


@pytest.fixture(scope="module")
def texts():
    return corpus(260)


@pytest.fixture(scope="module")
def truth(texts):
    made = [grams(t) for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near(made[i], made[j])}


def test_features():
    cps, lens = canon.code_points(["abcd", "", "a", "abab", "abcd" * 2])
    row, code = bigrams(cps, lens)
    assert np.bincount(row, minlength=5).tolist() == [3, 0, 0, 2, 4]
    sketch = parity_sketch(row, code, 5)
    assert sketch[1].tolist() == [0, 0]
    rows, h = fingerprints(cps, lens)
    assert set(rows.tolist()) == {0, 2, 3, 4}
    one = fingerprints(*canon.code_points(["abcd"]))[1]
    assert one[0] in h[rows == 0]
    assert jaccard(["ab", "a", "", "abc", "a"], ["ab", "a", "", "abd", "b"]).tolist() == [1.0, 1.0, 0.0, 1 / 3, 0.0]


def test_distance_of_sketches_is_a_lower_bound(texts):
    some = [t for t in texts if t][:150]
    cps, lens = canon.canonical_points(*canon.code_points(some), True)
    row, code = bigrams(cps, lens)
    sketch = parity_sketch(row, code, len(some))
    sets = [set(code[row == i].tolist()) for i in range(len(some))]
    for i, j in itertools.combinations(range(len(some)), 2):
        apart = int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
        assert apart <= len(sets[i] ^ sets[j])


def test_near_duplicates_equal_brute_force(spark, texts, truth):
    rows = spark.createDataFrame([(2 * i, 0, t) for i, t in enumerate(texts)] + [(2 * i + 1, 1, t) for i, t in enumerate(texts[:40])], "uid long, tbl int, text string").withColumn("form", F.lit("clash"))
    pairs, members = near_duplicates(rows)
    found = {r[:] for r in row_pairs(pairs, members).collect()}
    assert {(a // 2, b // 2) for a, b in found if a % 2 == 0} == truth
    assert {(a // 2, b // 2) for a, b in found if a % 2} == {(i, j) for i, j in truth if j < 40}
    every = groups(pairs, members).collect()
    assert len(every) == len({r["uid"] for r in every}) == sum(1 for t in texts if grams(t)[0]) + sum(1 for t in texts[:40] if grams(t)[0])


def test_hot_buckets_are_dealt_out(spark):
    """A bucket that holds most rows is dealt out to cells, large ones are compared in tiles, and no pair is lost."""
    rng = random.Random(5)
    base = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(40))
    texts = []
    for _ in range(400):  # one family, every two of them near
        at = rng.randrange(len(base))
        texts.append(base[:at] + chr(0x4E00 + rng.randrange(5000)) + base[at + 1 :])
    frame = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "uid long, side int, text string")
    common = Commonness.fit(frame, "text", hashed_bigrams, 0.002)
    keyed = neartext.rare_pieces(texts, common, 0.7, 64)
    assert np.bincount(keyed["row"]).max() > 30  # cells were made
    found = neartext.candidates(neartext.bucket_blocks(frame, common, 0.7, 3, False, 100), 3, tile=32)
    made = [grams(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if made[i][0] != made[j][0] and near(made[i], made[j])}
    assert len(want) > 70_000 and want <= {r[:] for r in found.collect()}


def test_copies_of_a_third_of_all_rows(spark):
    rows = spark.createDataFrame([(i, 0, "同一条请求反复出现编号HT482334" if i % 3 == 0 else f"别的请求第{i * 7919}号编号{i * 104729}") for i in range(240)], "uid long, tbl int, text string")
    pairs, members = near_duplicates(rows)
    made = row_pairs(pairs.where("false"), members)
    assert made.count() == 80 * 79 // 2
    assert members.groupBy("rep").count().agg(F.max("count")).first()[0] == 80


def test_cross_split_equals_brute_force(spark, texts, truth):
    side = {i: (1, 2, 2, 0, 1)[i % 5] for i in range(len(texts))}
    rows = spark.createDataFrame([(i, side[i], t) for i, t in enumerate(texts)], "uid long, side int, text string").withColumn("tbl", F.lit("clash"))
    found = {tuple(sorted(r[:])) for r in cross_split(rows).collect()}
    assert found == {(i, j) for i, j in truth if {side[i], side[j]} == {1, 2}}
    for r in cross_split(rows).collect():
        assert side[r["train_uid"]] == 1 and side[r["eval_uid"]] == 2
    assert cross_split(rows.where("side = 1")).count() == 0
    assert cross_split(rows.where("false")).count() == 0


def test_history_equals_brute_force(spark):
    """Winnowed fingerprints find texts that have content of their own in common; the texts here have, as requests do."""
    rng = random.Random(11)
    texts = []
    for _ in range(260):
        if rng.random() < 0.5 or not texts:
            texts.append("，".join("".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(4)) + rng.choice(PARTS) for _ in range(3)))
        else:
            body = rng.choice(texts)
            at = rng.randrange(len(body))
            texts.append(rng.choice([body, body[:at] + "请" + body[at:], "，".join(reversed(body.split("，"))), body.replace("，", ", ")]))
    texts += [None, "", " ", "\u200b", "a", "ａ", "b", "长" * 50 + "文" * 4000, "长" * 51 + "文" * 4000, "a"]
    made = [grams(t) for t in texts]
    truth = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near(made[i], made[j])}
    batch = {i: (None if i % 17 == 16 else i * 5 // len(texts)) for i in range(len(texts))}
    rows = spark.createDataFrame([(i, batch[i], t) for i, t in enumerate(texts)], "uid long, batch int, text string").withColumn("known", F.lit("clash"))
    want = {}
    for i, j in truth:
        for x, y in ((i, j), (j, i)):
            if batch[x] is not None and batch[y] is not None and batch[y] < batch[x]:
                want[x] = min(want.get(x, 1 << 40), y)
    assert {r["uid"]: r["match"] for r in already_accepted(rows).collect()} == want
    assert already_accepted(rows.where("batch = 0")).count() == 0
    assert already_accepted(rows.where("false")).count() == 0


def test_history_finds_variants_of_one_hot_template(spark):
    """Each text edits one template, which is in most rows, at four places of its own: all that two share is the template."""
    rng = random.Random(23)
    base = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    texts = []
    for i in range(40):
        body = list(base)
        for at in rng.sample(range(5, 115), 4):
            body[at] = chr(0x6000 + rng.randrange(9000))
        # both directions of size: later texts are shorter or longer than earlier ones
        texts.append("".join(body) + "".join(chr(0x6000 + rng.randrange(9000)) for _ in range(rng.randrange(12))))
    made = [grams(t) for t in texts]
    batch = [i * 4 // len(texts) for i in range(len(texts))]
    want = {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if batch[i] < batch[j] and near(made[i], made[j]):
            want[j] = min(want.get(j, 1 << 40), i)
    assert len(want) > 20
    rows = spark.createDataFrame([(i, batch[i], t) for i, t in enumerate(texts)], "uid long, batch int, text string")
    assert {r["uid"]: r["match"] for r in already_accepted(rows).collect()} == want


def test_bloom_filters_forget_nothing():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    bits = bloom_bits(keys[:2500])
    assert bloom_has(bits, keys[:2500]).all()
    assert bloom_has(bits, keys[2500:]).mean() < 0.02
    assert not bloom_has(bloom_bits(keys[:0]), keys).any()


def _batches(n, each, seed=31):
    rng = random.Random(seed)
    texts = []
    for _ in range(n * each):
        if rng.random() < 0.6 or len(texts) < 3:
            texts.append("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(30)))
        else:
            body = rng.choice(texts)
            at = rng.randrange(len(body))
            texts.append(body[:at] + "请" + body[at:])
    return texts


def test_a_store_is_opened_again_and_merged(spark, tmp_path):
    """Half of the batches are accepted by one object, the rest by one that opens its folder, with a merge on the way; no pair is lost or found twice."""
    texts = _batches(8, 30)
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").withColumn("batch", (F.col("uid") / 30).cast("int"))
    one = lambda b: rows.where(F.col("batch") == b).select("uid", "text")
    store = History.create(spark, str(tmp_path / "store"), Commonness.fit(one(0), "text", hashed_bigrams, 0.002), 0.7, len(texts))
    found = []
    for b in range(4):
        found.append(store.accept(b, one(b)))
    store.merge()
    again = History.open(spark, str(tmp_path / "store"))
    assert again.batches == [3] and again.version == 1
    for b in range(4, 8):
        found.append(again.accept(b, one(b)))
    assert found[0] is None
    pairs = {r[:] for f in found[1:] for r in f.distinct().collect()}
    made = [grams(t) for t in texts]
    want = {(j, i) for i, j in itertools.combinations(range(len(texts)), 2) if i // 30 < j // 30 and near(made[i], made[j])}
    assert len(want) > 40 and want <= pairs and all(b // 30 < a // 30 for a, b in pairs)
    with pytest.raises(ValueError):
        again.accept(7, one(7))


def test_parts_without_a_known_key_are_not_read(spark, tmp_path):
    """A batch of which the filters know nothing reads no block of the history."""
    store = History.create(spark, str(tmp_path / "store"), Commonness(bytes(1 << 18), 1000), 0.7)
    store.accept(0, spark.createDataFrame([(i, t) for i, t in enumerate(_batches(1, 50))], "uid long, text string"))
    fresh = spark.createDataFrame([(100, "αβγδεζηθικλμνξοπρστυφχψω")], "uid long, text string")
    assert store.accept(1, fresh).count() == 0
    plan = store.accept(2, fresh.select((F.col("uid") + 1).alias("uid"), "text"))
    assert {r[:] for r in plan.collect()} == {(101, 100)}


def test_comparison_across_levels_equals_brute_force():
    """Long and short ranges, tiles and single pairs give what all pairs by the definition give."""
    rng = np.random.default_rng(5)

    def level(n, base):
        size = rng.integers(3, 40, n)
        s = rng.integers(0, 1 << 6, (n, 2)).astype(np.uint64)
        text = np.repeat(np.arange(n), 4)
        return level_of({"uid": np.arange(base, base + n), "size": size, "s0": s[:, 0], "s1": s[:, 1], "key": rng.integers(0, 5, 4 * n).astype(np.uint32), "text": text, "first": rng.random(4 * n) < 0.4, "place": rng.integers(0, 4, 4 * n).astype(np.uint8)})

    x, y = level(400, 0), level(900, 1000)
    for larger in (False, True):
        got = {(int(a), int(b)) for p in across(x, y, 0.7, larger, 16) for a, b in zip(*p, strict=True)}
        want = set()
        for i in range(len(x["keys"])):
            for j in np.flatnonzero(y["keys"] == x["keys"][i]):
                a, b = int(x["texts"][i]), int(y["texts"][j])
                p, q = int(x["size"][a]), int(y["size"][b])
                apart = bin(int(x["s0"][a] ^ y["s0"][b])).count("1") + bin(int(x["s1"][a] ^ y["s1"][b])).count("1")
                fits = y["first"][j] and 0.7 * p - 1e-9 <= q < p if larger else x["first"][i] and p <= q <= p / 0.7 + 1e-9
                room = (p - int(x["places"][i])) * 1.7 / 0.7 - p + 1e-6
                if fits and q <= room and apart <= neartext.radius(p, q, 0.7):
                    want.add((a, b))
        assert got == want and len(want) > 1000
