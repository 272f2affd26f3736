import itertools

import pytest
from pyspark.sql import functions as F

from quillmere.functions.jsonvalue import strict_json
from quillmere.operators.audit import review_closure, review_log, table_digest
from quillmere.operators.contracts import compile_schema, interval_faults, lint
from quillmere.operators.decide import covers_all, first_failure, merged_route, rewrite, verdict
from quillmere.operators.generate import response_labels
from quillmere.operators.intervals import overlaps
from quillmere.operators.metrics import rate, thousandths_mean
from quillmere.operators.setops import key_differences, same_members, unseen
from quillmere.operators.similarity import shape_classes, similar_pairs
from quillmere.operators.tools import aggregate, convert, lookup, next_id, search, search_many


def test_search(spark):
    docs = spark.createDataFrame([(1, "差旅报销制度", "x"), (2, "合同", "合同期限"), (3, None, "合同")], "id int, title string, text string")
    assert [r["id"] for r in search(docs, "合同 期限", ["title", "text"]).collect()] == [2]
    assert search(docs, "  ", ["title", "text"]).count() == 0
    queries = spark.createDataFrame([("a", "合同"), ("b", " "), ("c", "无")], "query_id string, query string")
    assert sorted((r["query_id"], r["id"]) for r in search_many(docs, queries, ["title", "text"]).collect()) == [("a", 2), ("a", 3)]


def test_lookup_and_next_id(spark):
    records = spark.createDataFrame([("contract", "HT045771", 420000.0)], "t string, i string, amount double")
    asked = spark.createDataFrame([("contract", "HT045771"), ("shipment", "SH888114"), (None, None)], "t string, i string")
    assert sorted((r["status"], r["amount"]) for r in lookup(asked, records, ["t", "i"]).collect() if r["amount"]) == [("ok", 420000.0)]
    assert next_id(spark.createDataFrame([("EV-0004",), ("EV-0002",), (None,)], "e string"), "e", "EV-").first()[0] == "EV-0005"
    assert next_id(spark.createDataFrame([], "e string"), "e", "EV-").first()[0] == "EV-0001"


def test_aggregate(spark):
    rows = spark.createDataFrame([("a", 10.005, "x"), ("a", 0.01, "x"), ("b", -0.01, "y"), ("b", -0.02, "y")], "k string, v double, s string")
    got = {r["k"]: r for r in aggregate(rows, "v", ["k"]).collect()}
    assert got["a"]["n"] == 2 and got["b"]["mean_value"] == -0.02 and got["b"]["sum_value"] == -0.03
    none = aggregate(rows, "v", [], None, {"s": ["z"]}).first()
    assert none["status"] == "no_data" and none["n"] == 0 and none["mean_value"] is None
    with pytest.raises(Exception, match="a record has no v"):
        aggregate(spark.createDataFrame([(None,)], "v double"), "v").collect()
    with pytest.raises(ValueError):
        convert(F.lit(1), "cm", "kg")


def test_overlaps_equal_brute_force(spark):
    rows = [(u, i, s, s + n) for i, (u, s, n) in enumerate(itertools.product((1, 2), (0, 3599, 21600, 50000, 86399), (0, 1, 3600, 90000)))]
    base = spark.createDataFrame(rows, "user_id int, id int, s long, e long").select("user_id", "id", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    left = base.select("user_id", F.col("id").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = base.select("user_id", F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    got = sorted((r["l_id"], r["r_id"]) for r in overlaps(left, right, ["user_id"]).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])
    assert got == want


def test_similar_pairs_equal_brute_force(spark):
    texts = ["统计六月已完成的订单金额", "统计六月已经完成的订单金额", "订单金额统计六月已完成的", "查合同编号", "查合同的编号", "a", "", None, "ab", "ba", "统计六月已完成的订单金额"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")

    def grams(x):
        return {x[i : i + 2] for i in range(len(x) - 1)} if x else set()

    want = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        x, y = grams(a), grams(b)
        if x and y and len(x & y) / len(x | y) >= 0.6:
            want.add((i, j))
    assert {(r["a"], r["b"]) for r in similar_pairs(df, None, "id", "t", 0.6).collect()} == want
    right = spark.createDataFrame([(100, texts[0])], "id int, t string")
    assert {(r["a"], r["b"]) for r in similar_pairs(df, right, "id", "t", 0.6).collect()} >= {(0, 100), (1, 100), (10, 100)}
    shapes = {r["id"]: r["class"] for r in shape_classes(df, "id", "t").collect()}
    assert shapes[2] == 0 and shapes[10] == 0 and shapes[9] == 8


SCHEMA = {
    "type": "object",
    "required": ["a"],
    "properties": {
        "a": {"type": "integer", "enum": [1, 2]},
        "s": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^x"},
        "l": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "number"}},
        "o": {"type": "object", "minProperties": 1},
        "b": {"const": True},
        "n": {"anyOf": [{"type": "null"}, {"type": "string"}]},
    },
    "additionalProperties": False,
    "not": {"required": ["forbidden"]},
    "if": {"properties": {"a": {"const": 2}}, "required": ["a"]},
    "then": {"required": ["s"]},
    "else": {"properties": {"s": {"maxLength": 2}}},
}


@pytest.mark.parametrize(
    ("doc", "codes"),
    [
        ('{"a":1}', []),
        ("[]", ["/ TYPE_MISMATCH"]),
        ("{}", ["/a MISSING_REQUIRED"]),
        ('{"a":true}', ["/a TYPE_MISMATCH"]),
        ('{"a":1.5}', ["/a TYPE_MISMATCH"]),
        ('{"a":3}', ["/a ENUM_MISMATCH"]),
        ('{"a":2}', ["/s MISSING_REQUIRED"]),
        ('{"a":2,"s":"xyz"}', []),
        ('{"a":1,"s":"xyz"}', ["/s MAX_LENGTH"]),
        ('{"a":2,"s":"y"}', ["/s MIN_LENGTH", "/s PATTERN_MISMATCH"]),
        ('{"a":1,"l":[]}', ["/l MIN_ITEMS"]),
        ('{"a":1,"l":[1,1]}', ["/l DUPLICATE_ITEM"]),
        ('{"a":1,"l":[1,2,3]}', ["/l MAX_ITEMS"]),
        ('{"a":1,"l":[1,"x"]}', ["/l/1 TYPE_MISMATCH"]),
        ('{"a":1,"o":{}}', ["/o MIN_PROPERTIES"]),
        ('{"a":1,"b":1}', ["/b CONST_MISMATCH"]),
        ('{"a":1,"n":5}', ["/n ANY_OF_FAILED"]),
        ('{"a":1,"n":null}', []),
        ('{"a":1,"z":1}', ["/z EXTRA_FIELD"]),
        ('{"a":1,"forbidden":1}', ["/ FIELD_NOT_ALLOWED", "/forbidden EXTRA_FIELD"]),
    ],
)
def test_schema_codes(spark, doc, codes):
    errors = compile_schema(SCHEMA, F.col("v"))
    got = spark.createDataFrame([(doc,)], "d string").select(strict_json(F.col("d")).alias("v")).select(errors.alias("e")).first()["e"]
    assert sorted(f"{e['loc']} {e['code']}" for e in got) == sorted(codes)


def test_schema_lint():
    assert lint({"type": "string", "format": "x"}) == [("#/format", "UNSUPPORTED_KEYWORD")]
    assert lint({"pattern": "("}) == [("#/pattern", "BAD_PATTERN")]
    assert lint({"properties": {"a": 3}}) == [("#/properties/a", "BAD_SCHEMA_NODE")]
    assert lint({"items": {"anyOf": [{"bad": 1}]}}) == [("#/items/anyOf/0/bad", "UNSUPPORTED_KEYWORD")]
    with pytest.raises(ValueError):
        compile_schema({"format": "x"}, F.lit(None))


def test_interval_faults(spark):
    row = spark.range(1).select(interval_faults(F.lit("2026-05-01T10:00"), F.lit("2026-05-01T18:01"), F.lit("2026-05-01T10:01"), 480))
    assert row.first()[0] == ["SEMANTIC_DURATION", "SEMANTIC_PAST_START"]


def test_decisions(spark):
    one = spark.range(1)
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one.select(first_failure([("a", t), ("b", n), ("c", f)], "ok"), first_failure([("a", t)], "ok"), rewrite([("x", n), ("y", t), ("z", t)]), rewrite([("x", f)])).first()[:] == ("b", "ok", "y", None)
    call, clarify = F.lit("call"), F.lit("clarify")
    tool = (F.lit("t"), F.lit("t"))
    got = one.select(
        verdict(f, (call, call), tool, t, f, t), verdict(t, (call, clarify), tool, t, f, t), verdict(t, (call, call), (F.lit("t"), F.lit("u")), t, f, t), verdict(t, (call, call), tool, f, t, t),
        verdict(t, (call, call), tool, t, t, t), verdict(t, (call, call), tool, t, f, f), verdict(t, (clarify, clarify), tool, f, f, f), verdict(t, (clarify, clarify), tool, f, f, t),
    ).first()[:]
    assert got == ("invalid", "wrong", "wrong", "wrong", "manual_review", "correct", "wrong", "correct")
    terms = {"q": ["查"], "r": ["编号"]}
    got = one.select(*(covers_all(F.lit(text), F.array(*(F.lit(x) for x in fields)), terms) for text, fields in (("查编号", ["q", "r"]), ("查", ["q", "r"]), ("查", ["other"])))).first()[:]
    assert got == (True, False, False)
    assert one.select(merged_route(F.array(F.lit("a"), F.lit("a"))), merged_route(F.array(F.lit("a"), F.lit("b"))), merged_route(F.array(F.lit("a"), F.lit(None)))).first()[:] == ("a", None, None)


def test_rates_round_to_even(spark):
    assert spark.range(1).select(rate(F.lit(13), F.lit(32)), rate(F.lit(1), F.lit(0))).first()[:] == (0.4062, None)
    assert spark.createDataFrame([(1.0005,), (1.0,), (None,)], "v double").agg(thousandths_mean(F.col("v"))).first()[0] == 1001
    assert spark.createDataFrame([], "v double").agg(thousandths_mean(F.col("v"))).first()[0] is None


def test_set_operators(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("y",), ("z",), (None,)], "k string")
    assert sorted((r["k"], r["only_in"]) for r in key_differences(a.where("k is not null"), b.where("k is not null"), ["k"]).collect()) == [("x", "left"), ("z", "right")]
    assert [r["k"] for r in unseen(a, b, ["k"]).collect()] == ["x"]
    assert spark.range(1).select(same_members(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1)))).first()[0]


def test_audit(spark):
    a = spark.createDataFrame([(1, None), (2, "b")], "i int, t string")
    b = spark.createDataFrame([(2, "b"), (1, None)], "i int, t string")
    c = spark.createDataFrame([(2, "b"), (1, "")], "i int, t string")
    digest = [table_digest(x, ["i", "t"]).first()[:] for x in (a, b, c)]
    assert digest[0] == digest[1] != digest[2]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["## n", "- [x] A", "- [ ] B", "## m", "- [X] C", "text"])], "file string, line_no int, line string")
    log = review_log(lines)
    assert sorted(r[:] for r in log.collect()) == [("m", "C", True), ("n", "A", True), ("n", "B", False)]
    sampled = spark.createDataFrame([("A",), ("B",), ("D",)], "id string")
    assert sorted(r[:] for r in review_closure(sampled, log).collect()) == [("B", "UNCHECKED"), ("C", "PHANTOM"), ("D", "MISSING")]


def test_labels(spark):
    ok = spark.range(1).select(response_labels(F.array(F.lit(5), F.lit(6)), F.array(F.lit(7)), 3)).first()[0]
    assert ok == [-100, -100, 7]
    with pytest.raises(Exception, match="sequence too long"):
        spark.range(1).select(response_labels(F.array(F.lit(5), F.lit(6)), F.array(F.lit(7)), 2)).collect()


def test_json_paths_and_differences_at_any_depth(spark):
    from quillmere.operators.setops import json_differences, json_paths

    a = '{"a": {"b": {"c": {"d": 1, "e": "x, \\"}{[ y"}}}, "k/~": [1, {"z": 2, "y": []}], "o": {}, "n": null, "only": {"left": true}}'
    b = '{"n": null, "o": {"p": 1}, "k/~": [1, {"y": [], "z": 2}], "a": {"b": {"c": {"d": "1", "e": "x, \\"}{[ y"}}}}'
    made = [(1, a), (2, "[1, {}]"), (3, "7"), (4, "{"), (5, None), (6, "{}")]
    rows = spark.createDataFrame(made, "id int, doc string")
    got = {r["id"]: {x["path"]: x["value"] for x in r["p"]} for r in rows.select("id", json_paths(rows["doc"]).alias("p")).collect()}
    assert got[1] == {"/a/b/c/d": "1", "/a/b/c/e": '"x, \\"}{[ y"', "/k~1~0": '[1,{"y":[],"z":2}]', "/o": "{}", "/n": "null", "/only/left": "true"}
    assert [got[i] for i in range(2, 7)] == [{"": "[1,{}]"}, {"": "7"}, {}, {}, {"": "{}"}]
    long = '{"q": "' + 'w\\"' * 20_000 + '"}'
    left = spark.createDataFrame([(1, a), (2, long), (3, '{"g": 1}')], "id int, doc string")
    right = spark.createDataFrame([(1, b), (2, long)], "id int, doc string")
    different = {r[:] for r in json_differences(left, right, ["id"], "doc").collect()}
    assert different == {(1, "/a/b/c/d", "1", '"1"'), (1, "/o", "{}", None), (1, "/o/p", None, "1"), (1, "/only/left", "true", None), (3, "/g", "1", None)}


def test_manifest_and_input_drift(spark):
    from quillmere.operators.audit import input_drift, manifest_check

    frozen = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("e", 4, "w")], "name string, n long, digest string")
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "q"), ("d", 3, "z"), ("e", 5, "w")], "name string, n long, digest string")
    assert {r[:] for r in manifest_check(frozen, now).collect()} == {("b", "FROZEN_DRIFT"), ("c", "FROZEN_MISSING"), ("d", "NOT_FROZEN"), ("e", "FROZEN_DRIFT")}
    stored = spark.createDataFrame([("1", "p"), ("2", "q"), ("3", None), ("4", "s")], "id string, input string")
    rendered = spark.createDataFrame([("1", "p"), ("2", "r"), ("3", None), ("5", "t")], "id string, input string")
    assert {r[:] for r in input_drift(stored, rendered).collect()} == {("2", "INPUT_DRIFT"), ("4", "INPUT_ID_DRIFT"), ("5", "INPUT_MISSING")}


def test_lint_of_odd_nodes():
    from quillmere.operators.contracts import lint

    assert lint({"properties": ["a"]}) == [("#/properties", "BAD_SCHEMA_NODE")]
    assert lint({"required": "a", "enum": 3, "allOf": {}}) == [("#/required", "BAD_SCHEMA_NODE"), ("#/enum", "BAD_SCHEMA_NODE"), ("#/allOf", "BAD_SCHEMA_NODE")]
    assert lint({"additionalProperties": {"minimum": 1}, "anyOf": [5]}) == [("#/additionalProperties/minimum", "UNSUPPORTED_KEYWORD"), ("#/anyOf/0", "BAD_SCHEMA_NODE")]


def test_schema_of_undeclared_properties(spark):
    from pyspark.sql import functions as F

    from quillmere.functions.jsonvalue import strict_json
    from quillmere.operators.contracts import compile_schema

    schema = {"type": "object", "properties": {"a": {"type": "string"}}, "additionalProperties": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}
    rows = spark.createDataFrame([('{"a": "x", "b": {"n": 1}}',), ('{"a": 1, "b": {"n": "1"}, "c": 2}',), ("{}",), ('{"b": {}}',)], "d string")
    got = [sorted(f"{e['loc']} {e['code']}" for e in r["e"]) for r in rows.select(compile_schema(schema, strict_json(F.col("d"))).alias("e")).collect()]
    assert got == [[], ["/a TYPE_MISMATCH", "/b/n TYPE_MISMATCH", "/c TYPE_MISMATCH"], [], ["/b/n MISSING_REQUIRED"]]


def test_percentiles_by_ranks(spark):
    """A hot group, ties, null keys and null values give what linear interpolation over the sorted values gives."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from quillmere.operators.metrics import ranked_percentiles

    rng = random.Random(3)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else "cold", None if i % 11 == 0 else float(rng.choice([1, 2, 2, 5, rng.random() * 100, -3])), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, g string, v double, n long").repartition(7).withColumn("_v", F.lit("clash"))
    got = {r["g"]: (r["n"], r["at"]) for r in ranked_percentiles(df, ["g"], "v", "i", [0.0, 0.5, 0.95, 1.0]).collect()}
    for g in (None, "hot", "cold"):
        values = [v for _, k, v, _ in rows if k == g and v is not None]
        assert got[g][0] == len(values) and np.allclose(got[g][1], np.quantile(values, [0, 0.5, 0.95, 1]))
    assert ranked_percentiles(df.where("false"), ["g"], "v", "i", [0.5]).count() == 0


def test_similar_pairs_with_hot_pieces(spark, monkeypatch):
    from quillmere.operators import similarity

    rows = spark.createDataFrame([(i, "共同的开头文字" + "甲乙丙丁戊己庚辛"[i % 8] + str(i % 5)) for i in range(60)], "id int, t string")
    whole = sorted(r[:] for r in similarity.similar_pairs(rows, None, "id", "t", 0.6).collect())
    monkeypatch.setattr(similarity, "CELL", 7)
    assert sorted(r[:] for r in similarity.similar_pairs(rows, None, "id", "t", 0.6).collect()) == whole and len(whole) > 100


def shuffled_rows(plan):
    """Rows that the exchanges of a plan that has run wrote, reused ones once."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    if kind == "ReusedExchangeExec":
        return 0
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
    below = plan.children()
    return own + sum(shuffled_rows(below.apply(i)) for i in range(below.size()))


def test_similar_pairs_shuffle_few_candidates(spark):
    names = ["".join(x) for x in itertools.product(("仓库盘点", "车辆年检", "票据遗失"), ("审批", "核销", "追溯", "登记", "押金"), ("台账", "对照表", "流程图"))]
    left = [(i, x) for i, x in enumerate(y for _ in range(8) for n in names for y in (n + "口径不清", n + " 缺编号"))]
    right = [(1000 + i, x) for i, x in enumerate(y for _ in range(8) for n in names for y in (n, n + "（修订）", "关于" + n + "补充说明"))]
    df, other = (spark.createDataFrame(rows, "id int, t string") for rows in (left, right))

    def grams(x):
        x = x.replace(" ", "")
        return {x[i : i + 2] for i in range(len(x) - 1)}

    def near(x, y):
        return len(grams(x) & grams(y)) / len(grams(x) | grams(y))

    of = {(x, y): near(x, y) for x in {x for _, x in left} for y in {y for _, y in right}}
    want = sorted((i, j, of[x, y]) for i, x in left for j, y in right if of[x, y] >= 0.6)
    pairs = similar_pairs(df, other, "id", "t", 0.6)
    assert sorted(r[:] for r in pairs.collect()) == want and len(want) > 5000
    # 8,915; where copies meet one by one and sizes alone decide, 42,140
    assert shuffled_rows(pairs._jdf.queryExecution().executedPlan()) < 20_000


def test_similar_pairs_of_copies_stand_once_each(spark):
    df = spark.createDataFrame([(4, "查合同的编号"), (2, "查合同 的编号"), (9, "查合同的编号"), (1, "查合同编号"), (7, None), (8, " "), (5, "ab"), (3, "a b")], "id int, t string")
    got = sorted((r["a"], r["b"], round(r["similarity"], 4)) for r in similar_pairs(df, None, "id", "t", 0.5).collect())
    assert got == [(1, 2, 0.5), (1, 4, 0.5), (1, 9, 0.5), (2, 4, 1.0), (2, 9, 1.0), (3, 5, 1.0), (4, 9, 1.0)]


def test_contains_pairs_either_way(spark):
    from quillmere.operators.tools import contains_pairs

    texts = spark.createDataFrame([(1, "合同编号HT123456到期"), (2, "abcabcabcd"), (3, None), (4, ""), (5, "abc"), (6, "x" * 5000 + "HT123456")], "id int, text string")
    needles = spark.createDataFrame([("HT123456",), ("abcd",), ("bc",), (None,), ("",), ("zzzz",)], "needle string")
    want = {(1, "HT123456"), (2, "abcd"), (2, "bc"), (5, "bc"), (6, "HT123456")}
    for most in (10, 2):
        got = sorted((r["id"], r["needle"]) for r in contains_pairs(texts, "text", needles, "needle", most).collect())
        assert got == sorted(want)


def test_review_faults(spark):
    from quillmere.operators.audit import review_faults

    text = "# log\n## a\n- [x] A1\n- [ ] A2\n## b\n- [X] B1\n- [x] Z9\n## findings\n"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no int, line string")
    sampled = spark.createDataFrame([("a", "A1"), ("a", "A2"), ("a", "A3"), ("b", "B1")], "section string, id string")
    got = sorted(r[:] for r in review_faults(lines, sampled, 2, "findings").collect())
    assert got == [("A2", "UNCHECKED"), ("A3", "MISSING"), ("Z9", "PHANTOM"), ("a", "SHORT"), ("findings", "FINDINGS_EMPTY")]
    said = lines.unionAll(spark.createDataFrame([("f", 99, "two odd rows")], lines.schema))
    assert "FINDINGS_EMPTY" not in {r["code"] for r in review_faults(said, sampled, 1, "findings").collect()}


def test_projection_codes(spark):
    from pyspark.sql import functions as F

    from quillmere.operators.audit import projection_codes

    rows = [(0, "tools\nrequest: 查", "查", ["t1", None, ""], "请补充", []), (1, "seed 7 查 t1", "查", ["t1"], None, ["GOLD_LEAK"]), (2, "rationale 查", "查", [], "查", ["GOLD_LEAK", "GOLD_ANSWER_LEAK"]), (3, "x", "查", None, None, ["REQUEST_MISSING"]), (4, None, None, None, None, [])]
    df = spark.createDataFrame(rows, "i int, text string, request string, secrets array<string>, answer string, want array<string>")
    for r in df.select("want", projection_codes(F.col("text"), F.col("request"), ["rationale"], F.col("secrets"), F.col("answer")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_freeze_waits_for_errors(spark, tmp_path):
    import pytest

    from quillmere.operators.audit import freeze, manifest_check, table_digest
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a", [1.5, None], None), (2, None, None, "x")], "id int, t string, d array<double>, u string")
    now = table_digest(rows).select(F.lit("t").alias("name"), "n", "digest")
    errors = spark.createDataFrame([("E",)], "code string")
    with pytest.raises(ValueError, match="pending"):
        freeze(now, errors, str(tmp_path / "m"))
    freeze(now, errors.where("false"), str(tmp_path / "m"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        freeze(now, errors.where("false"), str(tmp_path / "m"))
    frozen = spark.read.schema("name string, n long, digest string").json(str(tmp_path / "m"))
    assert manifest_check(frozen, now).count() == 0
    for changed in (rows.withColumn("d", F.array(F.lit(1.5), F.lit(2.0))), rows.withColumn("u", F.lit("x")), rows.where("id = 1")):
        assert manifest_check(frozen, table_digest(changed).select(F.lit("t").alias("name"), "n", "digest")).first()["code"] == "FROZEN_DRIFT"


def test_content_of_questions_and_reasons(spark):
    from pyspark.sql import functions as F

    from quillmere.operators.decide import content_fine

    terms = {"multi_intent": ["先"], "boundary": ["不支持"], "fields": {"title": ["标题"], "start_time": ["几点"]}, "codes": {"bad_time": ["时间"]}}
    rows = [("clarify", "标题是什么，几点开始", False, ["title", "start_time"], None, True), ("clarify", "标题是什么", False, ["title", "start_time"], None, False), ("clarify", "先做哪一步", True, None, None, True), ("clarify", "标题？09:30？", False, ["title"], None, False), ("clarify", "标题？10:00？", False, ["title"], None, True), ("refuse", "不支持过去的时间", False, None, "bad_time", True), ("refuse", "过去的时间", False, None, "bad_time", False), ("refuse", "不支持", False, None, "other", False), ("call", "时间", False, None, None, False), (None, None, None, None, None, False)]
    df = spark.createDataFrame(rows, "action string, said string, multi boolean, fields array<string>, code string, want boolean")
    for r in df.select("want", "said", content_fine(F.col("action"), F.col("said"), F.lit("十点 10:00 开会"), F.col("multi"), F.col("fields"), F.col("code"), terms).alias("got")).collect():
        assert r["got"] == r["want"], r
