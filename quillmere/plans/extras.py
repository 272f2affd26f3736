"""Queries of dispatch, rendering, request bodies, time audits, isolation and contrastive pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.text import time_value
from quillmere.functions.timeexpr import relative_date, resolved, time_codes
from quillmere.operators.contracts import kind
from quillmere.operators.tools import convert, lookup
from quillmere.plans.texts import SQL as TEXT_SQL
from quillmere.session import table

#: Names of tools that only held-out data may offer.
HELD_OUT = ["unit_convert", "sort_records"]
#: One line of description for a tool, as it stands in a rendered input.
LINES = {"search_documents": "(query)", "get_record": "(record_type, record_id)", "calculate": "(expression)", "aggregate_data": "(dataset, metric, operation, filters)", "check_availability": "(start_time, end_time)", "create_event": "(title, start_time, end_time)"}


def t9_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Requests go to the branch of their tool, each a plan of its own, and come together again; other names are an error."""
    asked = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "get_record").when(F.col("event_type") == "click", "unit_convert").otherwise(F.col("event_type")).alias("tool"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("value"))
    branches = {
        "get_record": lambda rows: lookup(rows.withColumn("record_id", F.col("event_id") * 3), orders, ["record_id"]).select("event_id", "tool", "status", "value"),
        "unit_convert": lambda rows: rows.select("event_id", "tool", F.lit("ok").alias("status"), convert(F.col("event_id"), "m", "km").cast("double").alias("value")),
    }
    out = asked.where(~F.col("tool").isin(*branches)).select("event_id", "tool", F.lit("unknown_tool").alias("status"), F.lit(None).cast("double").alias("value"))
    for name, branch in branches.items():
        out = out.unionAll(branch(asked.where(F.col("tool") == name)))
    return out


def f21_rendered_input(spark: SparkSession, sf: str) -> DataFrame:
    """The text that a model would see of a case: its tools, the moment, the request."""
    lines = F.create_map(*(F.lit(x) for kv in LINES.items() for x in kv))
    tools = F.array_join(F.transform("available_tools", lambda t: F.concat(t, F.coalesce(lines[t], F.lit("()")))), "\n")
    rows = table(spark, sf, "handwritten_v0").where("user_request is not null and available_tools is not null")
    return rows.select("row_id", F.sha2(F.concat_ws("\n", tools, F.concat(F.lit("now: "), "context.now"), F.concat(F.lit("request: "), "user_request")), 256).alias("input_sha256"), F.size("available_tools").alias("tools"))


def f23_compact_json(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as compact JSON with the keys in one order."""
    rows = table(spark, sf, "groups_clarify").where("category is not null and label is not null and tags is not null")
    return rows.select("row_id", F.to_json(F.struct("id", "category", "label", "tags")).alias("json"))


def v19_json_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """JSON types of the parts of decisions."""
    v = F.try_parse_json("expected_decision")
    part = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), kind(F.try_variant_get(v, f"$.{p}", "variant")).alias("type")) for p in ("action", "tool", "arguments", "question", "reason")))).alias("e")
    return table(spark, sf, "handwritten_v0").select(part).where("e.type is not null").groupBy("e.part", "e.type").agg(F.count(F.lit(1)).alias("n"))


def v27_request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies against their limits: length, profile, token."""
    token = F.when(F.col("row_id") % 4 == 0, F.col("id")).otherwise(F.md5("id"))
    codes = [
        F.when(F.length("user_request") < 2, "TOO_SHORT"),
        F.when(F.length("user_request") > 120, "TOO_LONG"),
        F.when(F.col("user_request").isNull(), "MISSING_REQUIRED"),
        F.when(~F.col("category").isin("normal", "missing_param", "multi_intent"), "ENUM_MISMATCH"),
        F.when(~token.rlike("^[0-9a-f]{32}$"), "PATTERN_MISMATCH"),
    ]
    return table(spark, sf, "handwritten_v0").select("row_id", F.array_join(F.array_compact(F.array(*codes)), ",").alias("codes")).where("codes <> ''")


def audit_times(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of requests, resolved against their moment: unreadable, past, or clock times in the wrong order."""
    r = F.col("user_request")
    day = F.to_date(time_value(F.col("context.now")))
    clocks = F.transform(F.regexp_extract_all(r, F.lit("([0-9]{1,2}:[0-9]{2})"), F.lit(1)), lambda c: F.lpad(c, 5, "0"))
    codes = [
        F.when(r.rlike("今天|明天|后天|[上下]周[一二三四五六日天]|[0-9]{1,2} 月 [0-9]{1,2} 日") & relative_date(r, day).isNull(), "PHRASE_UNREADABLE"),
        F.when(relative_date(r, day) < day, "PAST"),
        F.when((F.size(clocks) >= 2) & (F.get(clocks, F.lit(1)) <= F.get(clocks, F.lit(0))), "CLOCK_ORDER"),
    ]
    rows = table(spark, sf, "handwritten_v0").where(r.isNotNull())
    return rows.select(F.explode(F.array_compact(F.array(*codes))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def audit_gold_times(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals against the phrases of all requests.  The decisions' own times are no minute timestamps, so an interval is made of
    each case's moment and seed: up to two days on, at the request's first clock time or at half past nine, up to ninety minutes or a day long."""
    r, seed = F.col("user_request"), F.col("seed")
    now = time_value(F.col("context.now"))
    first = F.regexp_extract(r, "([0-9]{1,2}:[0-9]{2})", 1)
    clock = F.when((first == "") | (seed % 5 == 0), "09:30").otherwise(F.lpad(first, 5, "0"))
    start = time_value(resolved(now, days=seed % 3, clock=clock))
    end = start + F.make_dt_interval(days=F.when(seed % 11 == 0, 1).otherwise(0), mins=((seed % 4) * 30).cast("int"))
    made = table(spark, sf, "handwritten_v0").where(r.isNotNull()).select("row_id", r.alias("r"), now.alias("now"), start.alias("s"), end.alias("e"))
    return made.select("row_id", F.explode(time_codes(F.col("r"), F.col("now"), F.col("s"), F.col("e"))).alias("code"))


def audit_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """Of each split, rows that offer a held-out tool and rows whose texts name one."""
    names = F.array(*(F.lit(x) for x in HELD_OUT))
    named = F.exists(names, lambda x: F.contains(F.concat_ws(" ", "user_request", "rationale", "expected_decision"), x))
    rows = table(spark, sf, "handwritten_v0")
    return rows.groupBy("split").agg(F.count_if(F.arrays_overlap("available_tools", names)).alias("offering"), F.count_if(named).alias("naming"), F.count(F.lit(1)).alias("n"))


def generate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Of each phrasing with a record number a pair: complete, and with the number left out."""
    each = table(spark, sf, "groups_clarify").select("row_id", F.posexplode("phrasings").alias("place", "phrasing"))
    number = "(DD|FP|HT|SH)[0-9]{6}"
    some = each.where(F.col("phrasing").rlike(number))
    pair = F.explode(F.array(F.struct(F.lit("complete").alias("kind"), F.col("phrasing").alias("request")), F.struct(F.lit("missing").alias("kind"), F.regexp_replace("phrasing", number, "").alias("request")))).alias("p")
    return some.select("row_id", "place", pair).select("row_id", "place", "p.kind", "p.request")


_DESCRIBED = "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in LINES.items()) + " else '()' end"
_DATED = TEXT_SQL["f16_relative_date"].replace("select row_id, cast(case", "select q, d, (case", 1).replace("end as varchar) as resolved", "end) as resolved", 1)
_PARTS = " union all ".join(f"select '{p}' as part, json_type(expected_decision, '$.{p}') as t from handwritten_v0 where json_valid(expected_decision)" for p in ("action", "tool", "arguments", "question", "reason"))
_NOW = "try_strptime(context.now, '%Y-%m-%dT%H:%M')"
_CLOCK = "case when regexp_extract(user_request, '[0-9]{1,2}:[0-9]{2}') = '' or seed % 5 = 0 then '09:30' else lpad(regexp_extract(user_request, '[0-9]{1,2}:[0-9]{2}'), 5, '0') end"
_DAYNAME = "case regexp_extract(q, '[上下]周([一二三四五六日天])', 1) when '一' then 0 when '二' then 1 when '三' then 2 when '四' then 3 when '五' then 4 when '六' then 5 when '日' then 6 when '天' then 6 end"
SQL = {
    "t9_dispatch": "select event_id, tool, case when tool = 'unit_convert' then 'ok' when tool = 'get_record' then case when o_orderkey is null then 'not_found' else 'ok' end else 'unknown_tool' end as status, case when tool = 'unit_convert' then event_id / 1000 when tool = 'get_record' then o_totalprice end as value from (select event_id, case event_type when 'view' then 'get_record' when 'click' then 'unit_convert' else event_type end as tool from events) e left join orders on tool = 'get_record' and o_orderkey = event_id * 3",
    "f21_rendered_input": f"select row_id, sha256(concat_ws(chr(10), array_to_string(list_transform(available_tools, lambda t: t || {_DESCRIBED}), chr(10)), 'now: ' || context.now, 'request: ' || user_request)) as input_sha256, cast(len(available_tools) as int) as tools from handwritten_v0 where user_request is not null and available_tools is not null",
    "f23_compact_json": "select row_id, cast(to_json({'id': id, 'category': category, 'label': label, 'tags': tags}) as varchar) as json from groups_clarify where category is not null and label is not null and tags is not null",
    "v19_json_kinds": f"select part, case t when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'NULL' then 'null' else t end as type, count(*) as n from ({_PARTS}) where t is not null group by 1, 2",
    "v27_request_bodies": "select row_id, codes from (select row_id, array_to_string(list_filter([case when length(user_request) < 2 then 'TOO_SHORT' end, case when length(user_request) > 120 then 'TOO_LONG' end, case when user_request is null then 'MISSING_REQUIRED' end, case when category not in ('normal', 'missing_param', 'multi_intent') then 'ENUM_MISMATCH' end, case when not regexp_full_match(case when row_id % 4 = 0 then id else md5(id) end, '[0-9a-f]{32}') then 'PATTERN_MISMATCH' end], lambda x: x is not null), ',') as codes from handwritten_v0) where codes <> ''",
    "audit_times": f"with r as ({_DATED}), c as (select *, list_transform(regexp_extract_all(q, '[0-9]{{1,2}}:[0-9]{{2}}'), lambda x: lpad(x, 5, '0')) as k from r) select code, count(*) as n from (select unnest(list_filter([case when regexp_matches(q, '今天|明天|后天|[上下]周[一二三四五六日天]|[0-9]{{1,2}} 月 [0-9]{{1,2}} 日') and resolved is null then 'PHRASE_UNREADABLE' end, case when resolved < d then 'PAST' end, case when len(k) >= 2 and k[2] <= k[1] then 'CLOCK_ORDER' end], lambda x: x is not null)) as code from c) group by 1",
    "audit_gold_times": f"""with m as (select h.row_id, user_request as q, seed, cast(r.resolved as date) as meant, {_NOW} as now, {_CLOCK} as clock from handwritten_v0 h join ({TEXT_SQL['f16_relative_date']}) r on h.row_id = r.row_id),
        s as (select *, case when clock < '24' and substr(clock, 4) < '60' then cast(now as date) + interval (seed % 3) day + cast(substr(clock, 1, 2) as int) * interval 1 hour + cast(substr(clock, 4) as int) * interval 1 minute end as s from m),
        t as (select *, s + interval (case when seed % 11 = 0 then 1 else 0 end) day + interval (seed % 4 * 30) minute as e, {_DAYNAME} as wd, regexp_matches(q, '今天|明天|后天|[上下]周[一二三四五六日天]|[0-9]{{1,2}} 月 [0-9]{{1,2}} 日') as named, list_transform(regexp_extract_all(q, '[0-9]{{1,2}}:[0-9]{{2}}'), lambda x: lpad(x, 5, '0')) as k from s)
        select row_id, unnest(list_filter([case when named and meant is null then 'PHRASE_UNREADABLE' end, case when cast(s as date) <> meant then 'TIME_RESOLVE_MISMATCH' end, case when wd <> isodow(s) - 1 then 'WEEKDAY_MISMATCH' end, case when len(k) > 0 and not list_contains(k, strftime(s, '%H:%M')) then 'CLOCK_MISMATCH' end, case when s < now then 'PAST_START' end, case when e <= s then 'REVERSED_RANGE' end,
        case when meant is not null and cast(e as date) <> cast(s as date) then 'RANGE_SPANS_DAYS' end, case when (contains(q, '上午') and (strftime(s, '%H:%M') >= '12:00' or strftime(e, '%H:%M') > '12:00')) or (contains(q, '下午') and (strftime(s, '%H:%M') < '12:00' or strftime(e, '%H:%M') < '12:00')) then 'WINDOW_PHRASE' end,
        case when regexp_matches(q, '本月|这个月') and not named and (s <> date_trunc('month', now) or e <> last_day(now) + interval 1439 minute) then 'MONTH_RANGE_MISMATCH' end], lambda v: v is not null)) as code from t""",
    "audit_isolation": "select split, count(*) filter (list_has_any(available_tools, ['unit_convert', 'sort_records'])) as offering, count(*) filter (contains(concat_ws(' ', user_request, rationale, expected_decision), 'unit_convert') or contains(concat_ws(' ', user_request, rationale, expected_decision), 'sort_records')) as naming, count(*) as n from handwritten_v0 group by 1",
    "generate_pairs": "select row_id, cast(i - 1 as int) as place, k as kind, case k when 'complete' then p else regexp_replace(p, '(DD|FP|HT|SH)[0-9]{6}', '', 'g') end as request from (select row_id, i, phrasings[i] as p from (select row_id, phrasings, unnest(range(1, len(phrasings) + 1)) as i from groups_clarify)), (values ('complete'), ('missing')) v(k) where regexp_matches(p, '(DD|FP|HT|SH)[0-9]{6}')",
}
QUERIES = {f.__name__: f for f in (t9_dispatch, f21_rendered_input, f23_compact_json, v19_json_kinds, v27_request_bodies, audit_times, audit_gold_times, audit_isolation, generate_pairs)}
