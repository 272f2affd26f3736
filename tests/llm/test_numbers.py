import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import quantiles
from quillmere.llm.components import components
from quillmere.llm.groupsplits import assign, closest_subset, record_components, split_plan
from quillmere.llm.mixture import flight, landing, mixture
from quillmere.llm.quantiles import RelativeRank, merged, percentiles, ranked_rows, sketches
from quillmere.llm.requests import group_number, plain_name, split_name


def rank_error(values, estimate, q):
    values = np.sort(values)
    low, high = np.searchsorted(values, estimate, "left") / len(values), np.searchsorted(values, estimate, "right") / len(values)
    return max(0.0, low - q, q - high)


@pytest.mark.parametrize("kind", ["normal", "sorted", "reversed", "ties", "heavy"])
def test_rank_error_is_relative_to_the_tail(kind):
    rng = np.random.default_rng(3)
    values = {"normal": rng.normal(size=200_000), "sorted": np.arange(200_000.0), "reversed": -np.arange(200_000.0), "ties": rng.integers(0, 20, 200_000).astype(float), "heavy": np.exp(rng.normal(0, 5, 200_000))}[kind]
    whole = RelativeRank()
    for part in np.array_split(values, 37):
        other = RelativeRank()
        for piece in np.array_split(part, 5):
            other.add(piece)
        whole.merge(RelativeRank.unpack(other.pack()))
    assert whole.n == len(values) and whole.quantiles([0, 1]) == [values.min(), values.max()]
    assert sum(len(v) << i for i, v in enumerate(whole.levels)) == whole.n
    assert sum(map(len, whole.levels)) < 20_000
    shares = [0.01, 0.1, 0.5, 0.9, 0.99, 0.999, 0.9999]
    for q, e in zip(shares, whole.quantiles(shares), strict=True):
        assert rank_error(values, e, q) <= 0.02 * (1 - q) + 1e-5


def test_small_groups_are_exact(spark):
    rows = [("a", 1, float(i)) for i in range(100)] + [(None, 1, 5.0), (None, 2, None), ("b", 2, float("nan")), ("c", 1, -1.0), ("c", 1, -1.0)]
    df = spark.createDataFrame(rows, "g string, d int, v double").withColumn("sketch", F.lit("clash"))
    days = sketches(df, ["g", "d"], "v")
    got = {r["g"]: r for r in percentiles(merged(days, ["g"]), ["g"], [0.01, 0.5, 1.0]).collect()}
    assert set(got) == {"a", None, "c"}
    assert got["a"]["at"] == [0.0, 49.0, 99.0] and got["a"]["n"] == 100 and got[None]["n"] == 1 and got["c"]["at"] == [-1.0] * 3
    assert percentiles(sketches(df.where("false"), ["g"], "v"), ["g"], [0.5]).count() == 0


def test_ranks_of_rows_either_way(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None, float(i)) for i in range(1000)], "k long, g string, v double")
    parts = sketches(df, ["g"], "v")
    sent = sorted(r[:] for r in ranked_rows(df, "k", "g", "v", parts).collect())
    monkeypatch.setattr(quantiles, "SENT_BYTES", 0)
    monkeypatch.setattr(quantiles, "RANKED", 50)
    assert sorted(r[:] for r in ranked_rows(df, "k", "g", "v", parts).collect()) == sent
    assert len(sent) == 1000 and sent[-1][3] == 1.0 and abs(sent[500][3] - 0.5) < 0.02


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 1), (2, None)] * 2
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_subset_sums_are_the_closest():
    rng = random.Random(6)
    cases = [({45: 16, 50: 17}, 785), ({50: 17, 45: 16, 1: 1}, 786), ({9: 40, 10: 3}, 179)]
    for _ in range(3000):
        sizes = {rng.randint(1, 60): rng.randint(1, 20) for _ in range(rng.randint(1, 4))}
        cases.append((sizes, rng.randint(0, sum(s * c for s, c in sizes.items()))))
    for sizes, target in cases:
        taken = closest_subset(sizes, target)
        reach = {0}
        for s, c in sizes.items():
            reach = {r + s * k for r in reach for k in range(c + 1)}
        assert all(0 <= taken[s] <= sizes[s] for s in sizes)
        assert abs(sum(s * n for s, n in taken.items()) - target) == min(abs(r - target) for r in reach)
    # beyond the span: a proportional part first, and units if the rest is still too large
    for sizes, target in (({1: 900_000, 3: 50_000, 40: 1000, 70_000: 2}, 109_000), ({100_003: 7, 90_001: 8, 77: 50}, 300_000)):
        taken = closest_subset(sizes, target, 5000)
        assert all(0 <= taken[s] <= sizes[s] for s in sizes) and abs(sum(s * n for s, n in taken.items()) - target) <= 20_000
        assert closest_subset(sizes, 0) == dict.fromkeys(sizes, 0)
    assert sum(s * n for s, n in closest_subset({1: 900_000, 3: 50_000, 40: 1000, 70_000: 2}, 109_000, 5000).items()) == 109_000
    plan = split_plan({1: 50_000, 7: 1000, 90_000: 1}, {"a": 0.8, "b": 0.1, "c": 0.1})
    assert all(abs(sum(s * n for s, n in plan[k].items()) - 14_700) <= 1 for k in ("b", "c"))
    assert closest_subset({}, 5) == {}


def test_assigned_groups_stay_whole(spark):
    rng = random.Random(8)
    rows = [(i, None if i % 50 == 0 else f"TG-{min(int(rng.expovariate(0.05)), 90)}" if rng.random() < 0.7 else "TG-0") for i in range(1200)]
    records = spark.createDataFrame(rows, "row_id long, name string")
    links = records.where("name is not null").select(F.col("name").alias("u"), F.col("name").alias("v"))
    done = assign(record_components(records, links)).collect()
    assert len(done) == len(rows)
    by_group = {}
    for r in done:
        by_group.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_group.values())
    n = {s: sum(r["split"] == s for r in done) for s in ("train", "validation", "test")}
    assert n["validation"] == n["test"] == 120
    assert assign(spark.createDataFrame([], "row_id long, component string")).count() == 0


def test_linked_rows_through_chains(spark, tmp_path):
    """Rows of one request under several groups, and of one group with several requests, are one component however long the chain."""
    from quillmere.llm.queries import p4_linked

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    rows = [(i, f"TG-{i // 2:04d}", f"请求{(i + 1) // 2}") for i in range(40)] + [(40, None, "别的"), (41, None, "别 的"), (42, None, None), (43, "tg_0100", ""), (44, "TG-100", None)]
    write("handwritten_v0", [(a, b, c, "train") for a, b, c in rows], "row_id long, template_group string, user_request string, split string")
    write("groups_clarify", [("TG-1", "val")], "id string, split string")
    got = {r["row_id"]: (r["component"], r["split"]) for r in p4_linked(spark, str(tmp_path)).collect()}
    assert len(got) == 45 and len({got[i] for i in range(40)}) == 1
    assert got[40] == got[41] and got[43] == got[44] and len({c for c, _ in got.values()}) == 4


def test_ways_of_writing(spark):
    rows = spark.createDataFrame([("ｔｒａｉｎ", "TG‑000012"), (" Valid ", "tg_12"), ("Unseen Test", "ＴＧ－１２"), ("unseen-test", "TG"), ("other", None), (None, "TG-000")], "s string, g string")
    got = rows.select(split_name(F.col("s")), group_number(F.col("g")), plain_name(F.col("s"))).collect()
    assert [r[0] for r in got] == ["train", "val", "unseen_test", "unseen_test", None, None]
    assert [r[1] for r in got] == ["12", "12", "12", None, None, "0"]
    assert got[2][2] == "unseen_test"


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 1000, 500)
    tokens[::7] = 50
    p = rng.random(500)
    out = flight(p, tokens, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert math.isclose(out.sum(), p.sum(), abs_tol=1e-5) and math.isclose((out * tokens).sum(), (p * tokens).sum(), abs_tol=1e-2)
    mean = np.mean([flight(np.full(6, 0.3), np.array([1, 2, 3, 4, 5, 6]), rng) for _ in range(4000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.04
    reserve = np.zeros(500, bool)
    reserve[:100] = True
    landed = landing(p, tokens, np.zeros(500), np.ones(500), reserve, float((p * tokens).sum()), rng)
    assert set(landed.tolist()) <= {0.0, 1.0} and abs((landed * tokens).sum() - (p * tokens).sum()) < 2
    assert flight(np.zeros(0), np.zeros(0), rng).tolist() == []


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(9)
    docs = [(i, ("big", "mid", "small", "other", None)[min(int(rng.expovariate(0.9)), 4)], " ".join([f"word{i}"] * rng.randint(5, 200))) for i in range(1500)]
    docs += [(2000, "big", None), (2001, "big", ""), (2002, "mid", "  "), (2003, "small", docs[0][2]), (2004, "small", docs[0][2]), (2005, "small", "long text " * 1000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    used, report = mixture(df, targets)
    shares = {r["source"]: r for r in report.collect()}
    for source, aim in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(shares[source]["actual_share"] - aim / 0.95) < 2e-3, (source, [r[:] for r in shares.values()])
        assert shares[source]["most_repeats"] <= shares[source]["max_repeats"]
    assert shares["absent"]["tokens"] == 0 and shares["absent"]["actual_share"] == 0
    rows = used.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and not {2000, 2001, 2002} & {r["doc_id"] for r in rows}
    text = {i: t for i, _, t in docs}
    assert len({text[r["doc_id"]] for r in rows}) == len(rows)
    used, report = mixture(df.where("false"), targets)
    assert used.count() == 0 and report.count() == 4
