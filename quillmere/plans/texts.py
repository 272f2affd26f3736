"""Queries of the text and date functions over requests, route cases, template groups and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.functions.jsonvalue import canonical_json, strict_json
from quillmere.functions.timeexpr import relative_date, resolved
from quillmere.session import table

REQUEST = "user_request"


def _cases(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "handwritten_v0").select("row_id", "user_request", *columns)

#: A clock time, and a number with a unit.
CLOCK, UNIT = "([01]?[0-9]|2[0-3]):[0-5][0-9]", "[0-9]+(件|元|天|份|台|吨|公斤|小时|分钟)"


def f1_strip_space(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("row_id", X.strip_space(F.col(REQUEST)).alias("dense"))


def f2_normalize_request(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("row_id", X.normalize_request(F.col(REQUEST)).alias("normalized"))


def f3_normalize_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "agent_route_pairwise_v5").select("row_id", X.normalize_words(F.col("query")).alias("words"))


def f4_bigram_count(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("row_id", F.size(X.bigrams(F.col(REQUEST))).alias("bigrams"))


def f6_shape_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).where(F.col(REQUEST).isNotNull()).select("row_id", X.shape(F.col(REQUEST)).alias("shape"))


def f8_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.has_cjk(F.col("text")).alias("has_cjk"), X.estimate_tokens(F.col("text")).alias("tokens"))


def f9_hit_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.hits_any(F.col("text"), ["合同", "工单", "contract", "ticket"]).alias("hit"))


def f10_same_value(spark: SparkSession, sf: str) -> DataFrame:
    """Cases delivered more than once, and whether all their decisions are equal as values."""
    made = table(spark, sf, "handwritten_v0").where("expected_decision is not null").select("id", canonical_json(F.col("expected_decision")).alias("canonical"))
    return made.groupBy("id").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("canonical").alias("decisions")).where("deliveries > 1")


def f11_ungrounded_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """How many clock times of each rationale the whole request doesn't have."""
    made = _cases(spark, sf, "rationale").where(F.col(REQUEST).isNotNull() & F.col("rationale").isNotNull())
    return made.select("row_id", F.size(X.ungrounded_clocks(F.col("rationale"), F.col(REQUEST))).alias("ungrounded"))


def f11_ungrounded_times(spark: SparkSession, sf: str) -> DataFrame:
    """How many clock times of each rationale neither the request nor the context has, all of them read whole."""
    return ungrounded_rationales(_cases(spark, sf, "rationale", "context"))


def ungrounded_rationales(cases: DataFrame) -> DataFrame:
    """(row_id, ungrounded): clock times of each rationale without ground; a missing request or context grounds nothing."""
    source = F.concat_ws("|", REQUEST, F.to_json("context"))
    return cases.where("rationale is not null").select("row_id", F.size(X.ungrounded_clocks(F.col("rationale"), source)).alias("ungrounded"))


def f12_space_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("row_id", X.space_edges(F.col(REQUEST)).alias("spaced"))


def f13_fill_template(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "groups_clarify")
    return groups.select("row_id", X.fill_template("统计{label}的{category}共{n}条", {"label": F.col("label"), "category": F.col("category"), "n": F.size("phrasings")}).alias("filled"))


def f14_surface_forms(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "groups_clarify").where("label is not null")
    return groups.select("row_id", F.array_join(X.surface_forms(F.col("label"), ["缺编号", "编号", "号"]), "|").alias("forms"))


def f15_resolve_time(spark: SparkSession, sf: str) -> DataFrame:
    """Each form of a time slot against each case's moment, its numbers taken from the case's seed."""
    now, seed = X.time_value(F.col("context.now")), F.col("seed")
    spec = {
        "absolute": {"abs": F.col("context.now")},
        "month_start": {"month": seed % 12 + 1, "edge": F.lit("start")},
        "month_end": {"month": seed % 12 + 1, "edge": F.lit("end"), "year": F.year(now) + 1},
        "month_day": {"month": seed % 12 + 1, "day": seed % 31 + 1, "clock": F.lit("09:30")},
        "weekday": {"weekday": seed % 7, "weeks": seed % 4 - 1, "clock": F.lit("14:00")},
        "days": {"days": seed % 60 - 10},
    }
    return _cases(spark, sf, "context", "seed").select("row_id", *(resolved(now, **fields).alias(name) for name, fields in spec.items()))


def f16_relative_date(spark: SparkSession, sf: str) -> DataFrame:
    made = _cases(spark, sf, "context").where(F.col(REQUEST).isNotNull())
    return made.select("row_id", relative_date(F.col(REQUEST), F.to_date(X.time_value(F.col("context.now")))).cast("string").alias("resolved"))


def f17_time_literals(spark: SparkSession, sf: str) -> DataFrame:
    made = _cases(spark, sf).where(F.col(REQUEST).isNotNull())
    return made.select("row_id", F.array_join(F.regexp_extract_all(F.col(REQUEST), F.lit("([0-9]{1,2}:[0-9]{2})"), F.lit(1)), ",").alias("clocks"), F.size(F.regexp_extract_all(F.col(REQUEST), F.lit("([0-9]{1,2} 月)"), F.lit(1))).alias("months"))


def f22_parse_time(spark: SparkSession, sf: str) -> DataFrame:
    """The moment of each case and the start of its decision, as minute timestamps if they are readable."""
    start = F.get_json_object("expected_decision", "$.arguments.start_time")
    return table(spark, sf, "handwritten_v0").select("row_id", X.time_value(F.col("context.now")).cast("string").alias("moment"), X.time_value(start).cast("string").alias("start"), start.isNotNull().alias("given"))


def f24_two_tasks(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "agent_route_pairwise_v5").where("query is not null")
    parts = X.two_tasks(F.col("query"))
    return made.select("row_id", X.names_second_task(F.col("query")).alias("second_task"), parts[0].alias("first"), parts[1].alias("second"))


def f27_feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Clock times from 0:00 to 23:59 that no further digit touches, numbers with a unit, and whether a record number stands by itself."""
    r = F.col(REQUEST)
    return _cases(spark, sf).where(r.isNotNull()).select("row_id", F.regexp_count(r, F.lit(f"(?<![0-9]){CLOCK}(?![0-9])")).alias("clocks"), F.regexp_count(r, F.lit(UNIT)).alias("units"), r.rlike("(?<![0-9A-Za-z])(DD|FP|HT|SH)[0-9]{6}(?![0-9])").alias("has_record_id"))


def f28_parse_decision(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "handwritten_v0").select(strict_json(F.col("expected_decision")).alias("v"))
    return made.groupBy(F.try_variant_get("v", "$.action", "string").alias("action"), F.col("v").isNotNull().alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_DENSE = f"regexp_replace(user_request, '{_WS}', '', 'g')"
_NORMAL = "translate(regexp_replace(" + _DENSE + ", '[0-9]+', '#', 'g'), '" + X.PUNCTUATION.replace("'", "''") + "', '')"
_NOW = "cast(try_strptime(context.now, '%Y-%m-%dT%H:%M') as date)"
_MONDAY = "(d - cast(isodow(d) - 1 as int))"
_WEEKDAY = "case regexp_extract(q, '[上下]周([一二三四五六日天])', 1) when '一' then 0 when '二' then 1 when '三' then 2 when '四' then 3 when '五' then 4 when '六' then 5 else 6 end"


def _minute(text: str) -> str:
    return f"case when regexp_full_match({text}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}') then try_strptime({text}, '%Y-%m-%dT%H:%M') end"


#: A decision in one order of its keys and of its arguments' keys, white space of an expression left out; decisions have no arrays.
_VALUE = """case when d is not null then array_to_string(list_sort(list_transform(json_keys(d), lambda k: k || '=' || case when k = 'arguments' then array_to_string(list_sort(list_transform(json_keys(d, '$.arguments'),
    lambda a: a || ':' || case when a = 'expression' then regexp_replace(cast(json_extract(d, '$.arguments.' || a) as varchar), '[\\s\\x{3000}\\x{A0}]+', '', 'g') else cast(json_extract(d, '$.arguments.' || a) as varchar) end)), ',') else cast(json_extract(d, '$.' || k) as varchar) end)), ';') end"""
SQL = {
    "f1_strip_space": f"select row_id, {_DENSE} as dense from handwritten_v0",
    "f2_normalize_request": f"select row_id, {_NORMAL} as normalized from handwritten_v0",
    "f3_normalize_words": r"select row_id, lower(regexp_replace(query, '[^\p{L}\p{N}_]', '', 'g')) as words from agent_route_pairwise_v5",
    "f4_bigram_count": f"select row_id, case when s is null or length(s) < 2 then 0 else len(list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))) end as bigrams from (select row_id, {_DENSE} as s from handwritten_v0)",
    "f6_shape_mask": f"select row_id, array_to_string(list_sort(regexp_extract_all(s, '(?s).')), '') as shape from (select row_id, {_NORMAL} as s from handwritten_v0 where user_request is not null)",
    "f8_token_estimate": "select doc_id, regexp_matches(text, '[一-鿿]') as has_cjk, cast(k + (n - k + 3) // 4 as int) as tokens from (select doc_id, text, length(text) as n, length(regexp_replace(text, '[^一-鿿]', '', 'g')) as k from documents)",
    "f9_hit_terms": "select doc_id, contains(text, '合同') or contains(text, '工单') or contains(text, 'contract') or contains(text, 'ticket') as hit from documents",
    "f10_same_value": f"select id, count(*) as deliveries, count(distinct {_VALUE}) as decisions from (select id, case when json_valid(expected_decision) then expected_decision end as d from handwritten_v0 where expected_decision is not null) group by 1 having count(*) > 1",
    "f11_ungrounded_clocks": f"select row_id, cast(len(list_filter(regexp_extract_all(rationale, '[0-9]{{1,2}}:[0-9]{{2}}'), lambda x: not contains(regexp_replace(user_request, '{_WS}', '', 'g'), x))) as int) as ungrounded from handwritten_v0 where user_request is not null and rationale is not null",
    "f11_ungrounded_times": f"select row_id, cast(len(list_filter(regexp_extract_all(rationale, '[0-9]{{1,2}}:[0-9]{{2}}'), lambda x: not contains(regexp_replace(concat_ws('|', user_request, cast(to_json(context) as varchar)), '{_WS}', '', 'g'), x))) as int) as ungrounded from handwritten_v0 where rationale is not null",
    "f12_space_edges": r"select row_id, regexp_replace(regexp_replace(user_request, '([一-鿿])([0-9A-Za-z])', '\1 \2', 'g'), '([0-9A-Za-z])([一-鿿])', '\1 \2', 'g') as spaced from handwritten_v0",
    "f13_fill_template": r"select row_id, regexp_replace(regexp_replace('统计' || label || '的' || category || '共' || len(phrasings) || '条', '([一-鿿])([0-9A-Za-z])', '\1 \2', 'g'), '([0-9A-Za-z])([一-鿿])', '\1 \2', 'g') as filled from groups_clarify",
    "f14_surface_forms": "select row_id, case when suffix(label, '缺编号') then case when length(label) >= 5 then label || '|' || left(label, -3) else label end when suffix(label, '编号') and length(label) >= 4 then label || '|' || left(label, -2) when suffix(label, '号') and length(label) >= 3 then label || '|' || left(label, -1) else label end as forms from groups_clarify where label is not null",
    "f15_resolve_time": f"""select row_id, n as absolute, y || '-' || m || '-01T00:00' as month_start, strftime(last_day(make_date(y + 1, cast(m as int), 1)), '%Y-%m-%dT23:59') as month_end,
        case when seed % 31 + 1 <= day(last_day(make_date(y, cast(m as int), 1))) then y || '-' || m || '-' || lpad(cast(seed % 31 + 1 as varchar), 2, '0') || 'T09:30' end as month_day,
        strftime(date_trunc('week', d) + interval (7 * (seed % 4 - 1) + seed % 7) day, '%Y-%m-%dT14:00') as weekday, strftime(d + interval (seed % 60 - 10) day, '%Y-%m-%dT00:00') as days
        from (select row_id, seed, context.now as n, {_NOW} as d, year({_NOW}) as y, lpad(cast(seed % 12 + 1 as varchar), 2, '0') as m from handwritten_v0)""",
    "f16_relative_date": f"""select row_id, cast(case when contains(q, '大后天') then d + 3 when contains(q, '后天') then d + 2 when contains(q, '明天') then d + 1 when contains(q, '今天') then d
        when regexp_matches(q, '下周[一二三四五六日天]') then {_MONDAY} + 7 + {_WEEKDAY} when regexp_matches(q, '上周[一二三四五六日天]') then {_MONDAY} - 7 + {_WEEKDAY} when contains(q, '本周') then d
        when regexp_matches(q, '[0-9]{{4}} 年 [0-9]{{1,2}} 月 [0-9]{{1,2}} 日') then try_cast(regexp_replace(regexp_extract(q, '[0-9]{{4}} 年 [0-9]{{1,2}} 月 [0-9]{{1,2}} 日'), '([0-9]+) 年 ([0-9]+) 月 ([0-9]+) 日', '\\1-\\2-\\3') as date)
        when regexp_matches(q, '[0-9]{{1,2}} 月 [0-9]{{1,2}} 日') then try_cast((year(d) - case when cast(regexp_extract(q, '([0-9]{{1,2}}) 月 [0-9]{{1,2}} 日', 1) as int) > month(d) + 6 then 1 else 0 end) || regexp_replace(regexp_extract(q, '[0-9]{{1,2}} 月 [0-9]{{1,2}} 日'), '([0-9]+) 月 ([0-9]+) 日', '-\\1-\\2') as date) end as varchar) as resolved
        from (select row_id, user_request as q, {_NOW} as d from handwritten_v0 where user_request is not null)""",
    "f17_time_literals": "select row_id, array_to_string(regexp_extract_all(user_request, '[0-9]{1,2}:[0-9]{2}'), ',') as clocks, cast(len(regexp_extract_all(user_request, '[0-9]{1,2} 月')) as int) as months from handwritten_v0 where user_request is not null",
    "f22_parse_time": f"select row_id, cast({_minute('context.now')} as varchar) as moment, cast({_minute('s')} as varchar) as start, s is not null as given from (select *, case when json_valid(expected_decision) then json_extract_string(expected_decision, '$.arguments.start_time') end as s from handwritten_v0)",
    "f24_two_tasks": f"select row_id, second_task, case when ok then p[1] end as first, case when ok then p[2] end as second from (select *, len(p) = 2 and length(p[1]) >= 5 and length(p[2]) >= 5 as ok from (select row_id, regexp_matches(query, '{X.SECOND_TASK}') as second_task, string_split_regex(regexp_replace(trim(query), '[。！？!?]+$', ''), '[\\t\\n\\x0B\\f\\r ]*[，,；;][\\t\\n\\x0B\\f\\r ]*(?:再|然后|接着|同时|并且|还要|另外)[\\t\\n\\x0B\\f\\r ]*') as p from agent_route_pairwise_v5 where query is not null))",
    "f27_feature_counts": r"select row_id, cast(len(list_filter(regexp_extract_all(user_request, '[0-9]+:[0-9]+'), lambda x: regexp_full_match(x, '([01]?[0-9]|2[0-3]):[0-5][0-9]'))) as int) as clocks, cast(len(regexp_extract_all(user_request, '[0-9]+(件|元|天|份|台|吨|公斤|小时|分钟)')) as int) as units, regexp_matches(user_request, '(^|[^0-9A-Za-z])(DD|FP|HT|SH)[0-9]{6}($|[^0-9])') as has_record_id from handwritten_v0 where user_request is not null",
    "f28_parse_decision": "select case when json_valid(expected_decision) then json_extract_string(expected_decision, '$.action') end as action, coalesce(json_valid(expected_decision), false) as parsed, count(*) as n from handwritten_v0 group by 1, 2",
}
QUERIES = {f.__name__: f for f in (f1_strip_space, f2_normalize_request, f3_normalize_words, f4_bigram_count, f6_shape_mask, f8_token_estimate, f9_hit_terms, f10_same_value, f11_ungrounded_clocks, f11_ungrounded_times, f12_space_edges, f13_fill_template, f14_surface_forms, f15_resolve_time, f16_relative_date, f17_time_literals, f22_parse_time, f24_two_tasks, f27_feature_counts, f28_parse_decision)}
