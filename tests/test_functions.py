from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.functions.calc import calculate, evaluated
from quillmere.functions.jsonvalue import canonical_text, strict_json
from quillmere.functions.text import group_number, split_name, time_value
from quillmere.functions.timeexpr import month_edges, relative_date, resolved, time_codes, weekday_in_weeks


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(*columns).collect()]


@pytest.mark.parametrize(
    ("text", "value", "code"),
    [
        ("3*128.5*0.88+23.9", "363.14", None),
        ("200*10%", "20.00", None),
        ("2.5*60", "150.00", None),
        ("3*(4+6)/5-1.5", "4.50", None),
        ("50%%", "0.01", None),
        ("1++2", "3.00", None),
        ("-2*-3", "6.00", None),
        ("-(1+2)%", "-0.03", None),
        ("2-3-4", "-5.00", None),
        ("8/4/2", "1.00", None),
        ("0.125*1", "0.13", None),
        ("-0.125", "-0.13", None),
        ("5/0", None, "division_by_zero"),
        ("(1+2", None, "expression_syntax"),
        ("1++2)", None, "expression_syntax"),
        ("10%3", None, "expression_syntax"),
        (".5", None, "expression_syntax"),
        ("", None, "expression_syntax"),
        ("  ", None, "expression_syntax"),
        ("1 2", None, "expression_syntax"),
        ("2(3)", None, "expression_syntax"),
        ("()", None, "expression_syntax"),
        ("1+", None, "expression_syntax"),
        ("2^3", None, "expression_unsupported_char"),
        ("999999999999*999999999999", None, "value_out_of_range"),
        ("9999999999999", None, "value_out_of_range"),
        ("1" * 81, None, "value_out_of_range"),
        (None, None, "expression_syntax"),
    ],
)
def test_calculate(text, value, code):
    assert calculate(text) == (value, code)


def test_evaluated_column(spark):
    got = values(spark, ["1+1", "x", None], evaluated(F.col("t")).alias("e"))
    assert [tuple(r[0]) for r in got] == [(Decimal("2.00"), None), (None, "expression_unsupported_char"), (None, "expression_syntax")]


def test_spaces_of_unicode_go(spark):
    assert values(spark, ["a　b c\n", "", None], X.strip_space(F.col("t"))) == [("abc",), ("",), (None,)]


def test_request_forms(spark):
    got = values(spark, ["查 2026 年的单，好？", "12:30；A：B"], X.normalize_request(F.col("t")), X.shape(F.col("t")))
    assert [g[0] for g in got] == ["查#年的单好", "#:#；AB"]
    assert got[0][1] == "".join(sorted("查#年的单好"))


def test_bigrams_of_short_texts_are_empty(spark):
    assert values(spark, ["", "a", "ab", "abab", None], F.size(X.bigrams(F.col("t")))) == [(0,), (0,), (1,), (2,), (0,)]


def test_tokens_and_cjk(spark):
    assert values(spark, ["合同abcde", "", "abcd"], X.estimate_tokens(F.col("t")), X.has_cjk(F.col("t"))) == [(4, True), (0, False), (1, False)]


def test_templates(spark):
    got = values(spark, ["2026"], X.fill_template("统计{y}年", {"y": F.col("t")}), X.space_edges(F.lit("到15:30的")))
    assert got == [("统计 2026 年", "到 15:30 的")]
    with pytest.raises(ValueError):
        X.fill_template("{other}", {"y": F.lit(1)})


def test_surface_forms(spark):
    got = values(spark, ["差旅制度", "制度", "合同"], X.surface_forms(F.col("t"), ["制度", "度"]))
    assert [g[0] for g in got] == [["差旅制度", "差旅"], ["制度"], ["合同"]]


def test_two_tasks(spark):
    got = values(spark, ["帮我查今天的天气，然后导航去维修站。", "短，然后也短", "只有一件事情要做"], X.two_tasks(F.col("t")))
    assert got == [(["帮我查今天的天气", "导航去维修站"],), (None,), (None,)]


def test_relative_dates(spark):
    day = F.lit("2026-09-20").cast("date")  # a Sunday
    got = values(spark, ["大后天见", "后天", "明天", "今天", "下周三", "上周一", "本周内", "2025 年 2 月 28 日", "2 月 30 日", "12 月 1 日", "无"], relative_date(F.col("t"), day).cast("string"))
    assert [g[0] for g in got] == ["2026-09-23", "2026-09-22", "2026-09-21", "2026-09-20", "2026-09-23", "2026-09-07", "2026-09-20", "2025-02-28", None, "2026-12-01", None]
    edges = values(spark, ["x"], month_edges(F.lit("2024-02-11").cast("date")).alias("m"), weekday_in_weeks(day, 1, 0).cast("string"))
    assert tuple(edges[0][0]) == ("2024-02-01T00:00", "2024-02-29T23:59") and edges[0][1] == "2026-09-21"


def test_strict_json(spark):
    got = values(spark, ['{"a":1}', '{"a":1} x', "{'a':1}", "", None, "[1,2]"], strict_json(F.col("t")).isNotNull())
    assert [g[0] for g in got] == [True, False, False, False, False, True]


def test_canonical_json():
    assert canonical_text('{"b":[2,1],"a":1}') == canonical_text('{"a":1,"b":[1,2]}')
    assert canonical_text('{"a":860}') != canonical_text('{"a":860.0}')
    assert canonical_text('{"expression":"1 + 2"}') == canonical_text('{"expression":"1+2"}')
    assert canonical_text("{") is None and canonical_text(None) is None


def test_ungrounded_times_read_whole_texts(spark):
    from quillmere.plans.texts import ungrounded_rationales

    far = "长" * 500
    cases = [
        (1, "改到 09:30", "09:30 开会", "2026-06-15T16:47"),  # in the first characters of the request
        (2, "改到 10:45", far + "10:45", "2026-06-15T16:47"),  # far behind in it
        (3, "改到 16:47", "开会", "2026-06-15T16:47"),  # in the context
        (4, far + "改到 11:15 或 12:20", "11:15 开会", "2026-06-15T16:47"),  # one without ground, far behind in the rationale
        (5, "改到 11:15", None, None),
        (6, None, "11:15", None),
        (7, "不改", "11:15", None),
    ]
    rows = spark.createDataFrame([(i, r, q, None if n is None else (n,)) for i, r, q, n in cases], "row_id long, rationale string, user_request string, context struct<now string>")
    assert {r["row_id"]: r["ungrounded"] for r in ungrounded_rationales(rows).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 7: 0}


@pytest.mark.parametrize("text, code", [("1/0 2", "division_by_zero"), ("1/0(", "division_by_zero"), ("1/(0)5", "division_by_zero"), ("1/-0 2", "division_by_zero"), ("1/2 3", "expression_syntax"), ("(1/0", "division_by_zero"), ("(1/2", "expression_syntax"), ("1/", "expression_syntax"), ("2*0 1", "expression_syntax")])
def test_a_division_comes_before_the_break(text, code):
    assert calculate(text) == (None, code)


def test_names_however_written(spark):
    rows = spark.createDataFrame([(" Ｖalid ", "TG-007"), ("UNSEEN-test", "tg＿０４２ x"), ("dev", "none"), (None, None), ("nope", "0")], "s string, g string")
    got = [r[:] for r in rows.select(split_name(F.col("s")), group_number(F.col("g"))).collect()]
    assert got == [("val", "7"), ("unseen_test", "42"), ("val", None), (None, None), (None, "0")]


def test_resolved_time_slots(spark):
    moment = time_value(F.lit("2026-02-18T10:00"))
    slot = lambda **k: resolved(moment, **{n: F.lit(v) for n, v in k.items()})
    got = spark.range(1).select(slot(abs="2026-01-01T00:00"), slot(month=2, edge="end"), slot(month=12, edge="start", year=2027), slot(month=2, day=30), slot(month=3, day=5, clock="08:15"), slot(weekday=2, weeks=1, clock="09:00"), slot(days=-3), slot(month=1, edge="middle")).first()
    assert got[:] == ("2026-01-01T00:00", "2026-02-28T23:59", "2027-12-01T00:00", None, "2026-03-05T08:15", "2026-02-25T09:00", "2026-02-15T00:00", None)


@pytest.mark.parametrize(
    ("phrase", "start", "end", "codes"),
    [
        ("明天 10:00 开会", "2026-02-19T10:00", "2026-02-19T11:00", []),
        ("明天 10:00 开会", "2026-02-20T10:30", "2026-02-20T10:30", ["TIME_RESOLVE_MISMATCH", "CLOCK_MISMATCH", "REVERSED_RANGE"]),
        ("今天", "2026-02-18T09:00", "2026-02-19T09:30", ["PAST_START", "RANGE_SPANS_DAYS"]),
        ("下周三", "2026-02-25T09:00", "2026-02-25T10:00", []),
        ("下周四", "2026-02-25T09:00", "2026-02-25T10:00", ["TIME_RESOLVE_MISMATCH", "WEEKDAY_MISMATCH"]),
        ("2 月 30 日", "2026-03-02T09:00", "2026-03-02T10:00", ["PHRASE_UNREADABLE"]),
        ("明天上午", "2026-02-19T11:00", "2026-02-19T13:00", ["WINDOW_PHRASE"]),
        ("明天下午", "2026-02-19T12:00", "2026-02-19T13:00", []),
        ("本月的安排", "2026-02-01T00:00", "2026-02-28T23:59", ["PAST_START"]),
        ("本月的安排", "2026-02-18T10:30", "2026-02-28T23:59", ["MONTH_RANGE_MISMATCH"]),
        (None, "2026-02-19T11:00", None, []),
    ],
)
def test_time_codes(spark, phrase, start, end, codes):
    text = lambda x: F.lit(x).cast("string")
    assert spark.range(1).select(time_codes(text(phrase), time_value(text("2026-02-18T10:00")), time_value(text(start)), time_value(text(end)))).first()[0] == codes
