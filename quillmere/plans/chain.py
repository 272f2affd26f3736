"""Queries of the decision chain: whole decisions against tools and intervals, the gate, executions, cases and sets of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.jsonvalue import strict_json
from quillmere.functions.text import PUNCTUATION, split_name, time_value
from quillmere.operators.chain import case_codes, decision_errors, decision_parts, document_codes, execution_audit, gate
from quillmere.operators.contracts import interval_faults
from quillmere.plans.contracts import ACTIONS, DECISION, TOOLS
from quillmere.plans.contracts import decision_rules as form_rules
from quillmere.plans.contracts import split_sql
from quillmere.session import table

RECORD = "(DD|FP|HT|SH)[0-9]{6}"
#: Arguments of the tools, as the cases name them.
SCHEMAS = {
    "search_documents": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 4, "maxLength": 60}}, "additionalProperties": False},
    "get_record": {"type": "object", "required": ["record_type", "record_id"], "properties": {"record_type": {"type": "string", "minLength": 2}, "record_id": {"type": "string", "pattern": f"^{RECORD}$"}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string", "pattern": r"^[0-9+*/(). -]+$", "maxLength": 200}}, "additionalProperties": False},
    "aggregate_data": {"type": "object", "required": ["dataset", "metric"], "properties": {"dataset": {"type": "string", "minLength": 2}, "metric": {"type": "string", "minLength": 2}, "filters": {"type": "object"}}, "additionalProperties": False},
    "check_availability": {"type": "object", "required": ["start_time", "end_time"], "properties": {"start_time": {"type": "string", "minLength": 10}, "end_time": {"type": "string", "minLength": 4}}, "additionalProperties": False},
    "create_event": {"type": "object", "required": ["title", "start_time"], "properties": {"title": {"type": "string", "minLength": 2}, "start_time": {"type": "string"}, "end_time": {"type": "string"}}, "additionalProperties": False},
}
WRITER, LONGEST = "create_event", 480
TAGS = [
    "multi_intent", "time_ambiguous", "relative_time", "unsupported_record_type", "out_of_authority", "unsupported_operation", "nonexistent_record", "missing_required_field",
    "unavailable_tool", "normal_call", "context_reference", "infeasible_time", "tool_composition", "ambiguous_data_source", "write_pending_confirmation", "filtered_aggregation", "spoken_dialect",
]
CATEGORIES = ["normal", "irrelevant", "missing_param", "adversarial", "multi_intent", "time_ambiguous", "over_authority", "capability_boundary", "seasonal"]
SPLITS = ["train", "val", "test", "unseen_test"]
DATASETS = ["orders", "invoices", "contracts", "shipments"]


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "handwritten_v0")


def _given(now: Column) -> tuple:
    return now, DECISION, SCHEMAS, WRITER, LONGEST


def v18_interval_semantics(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of all route results as minute timestamps, from record to ingestion, the day of the run being now; two days at most."""
    minute = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm")
    codes = interval_faults(minute("recorded_at"), minute("ingested_at"), F.concat(F.col("run_day").cast("string"), F.lit("T12:00")), 2 * 1440)
    return table(spark, sf, "route_rows").groupBy(F.array_join(codes, ",").alias("codes")).agg(F.count(F.lit(1)).alias("n"))


def v18_argument_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of the intervals in the arguments of each case's decision."""
    c = _cases(spark, sf).select("row_id", "context.now", strict_json(F.col("expected_decision")).alias("v")).where("v is not null")
    return c.select("row_id", F.explode(decision_parts(F.col("v"), *_given(F.col("now")))["intervals"]).alias("e")).select("row_id", "e.loc", "e.code")


def v19_decision_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Every error of every decision: form, then tool, then its arguments, then intervals, counted by place and code."""
    c = _cases(spark, sf).select("context.now", strict_json(F.col("expected_decision")).alias("v"))
    errors = F.when(F.col("v").isNull(), F.array(F.struct(F.lit("/").alias("loc"), F.lit("JSON_SYNTAX").alias("code")))).otherwise(decision_errors(F.col("v"), *_given(F.col("now"))))
    return c.select(F.explode(errors).alias("e")).groupBy("e.loc", "e.code").agg(F.count(F.lit(1)).alias("n"))


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    c = _cases(spark, sf).withColumn("v", strict_json(F.col("expected_decision")))
    return c.withColumn("stage", gate(F.col("v"), F.col("available_tools"), *_given(F.col("context.now"))))


def gate_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Where decisions stop: form, offered tool, arguments, meaning; counted by stage."""
    return _gated(spark, sf).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def audit_executions(spark: SparkSession, sf: str) -> DataFrame:
    """Gold calls through the gate and the tools; records are those that documents name, the calendar is a ten-minute slot after each purchase event."""
    get = lambda p: F.try_variant_get("v", p, "string")
    cases = _gated(spark, sf).select(
        F.col("row_id").alias("key"), "stage", get("$.tool").alias("tool"), get("$.arguments.record_id").alias("record_id"), get("$.arguments.dataset").alias("dataset"),
        time_value(get("$.arguments.start_time")).alias("start"), time_value(get("$.arguments.end_time")).alias("end"), F.col("context.user_confirmed_write").alias("confirmed"), "tags",
    )
    records = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(RECORD), F.lit(0))).alias("record_id"))
    events = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("ts").cast("timestamp_ntz").alias("r_start"))
    calendar = events.withColumn("r_end", F.col("r_start") + F.expr("interval 10 minutes"))
    return execution_audit(cases, records, calendar, DATASETS, WRITER).withColumnRenamed("key", "row_id")


def v20_case_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules across the fields of a case, one code each."""
    c = {
        "request": F.col("user_request"), "context": F.to_json("context"), "confirmed": F.col("context.user_confirmed_write"), "decision": F.col("expected_decision"),
        "available": F.col("available_tools"), "tags": F.col("tags"), "target_tool": F.col("clarify_target.tool"), "target_fields": F.col("clarify_target.fields"), "has_target": F.col("clarify_target").isNotNull(),
        "refuse_code": F.col("refuse_code"), "blocking": F.lit(None).cast("array<string>"), "post_condition": F.col("post_condition"),
    }
    return _cases(spark, sf).select(F.explode(case_codes(c, SCHEMAS, WRITER)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def v21_document_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of the whole set of cases."""
    get = lambda p: F.get_json_object("expected_decision", p)
    cases = _cases(spark, sf).select("id", F.col("user_request").alias("request"), get("$.action").alias("action"), get("$.tool").alias("tool"), F.col("available_tools").alias("available"), "tags", "template_group")
    return document_codes(cases, TOOLS, ACTIONS, TAGS, (100, 2000), 20, 0.2)


def v28_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Actions, tools, categories and tags that a split lacks, of those that each split should have."""
    get = lambda p: F.get_json_object("expected_decision", p)
    each = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("action", get("$.action")), ("tool", get("$.tool")), ("category", F.col("category")))))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value")))
    seen = _cases(spark, sf).select(split_name(F.col("split")).alias("split"), F.explode(F.concat(each, tags)).alias("e")).select("split", "e.kind", "e.value").distinct()
    wanted = spark.createDataFrame([(s, k, v) for s in SPLITS for k, vs in (("action", ACTIONS), ("tool", TOOLS), ("category", CATEGORIES), ("tag", TAGS)) for v in vs], "split string, kind string, value string")
    return wanted.join(seen, ["split", "kind", "value"], "left_anti")


# ---- the same in SQL ----


def _text(path: str) -> str:
    return f"json_extract_string(d, '$.{path}')"


def _time(text: str) -> str:
    return f"case when regexp_full_match({text}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}') then try_strptime({text}, '%Y-%m-%dT%H:%M') end"


def argument_rules() -> list[tuple[str, str, str]]:
    """(place, code, condition) of the tools' schemas over a column d of valid JSON; extra fields are asked for apart."""
    rules = [("/arguments", "TYPE_MISMATCH", f"{_text('tool')} in ({', '.join(map(repr, SCHEMAS))}) and coalesce(json_type(d, '$.arguments'), '') <> 'OBJECT'")]
    for tool, schema in SCHEMAS.items():
        mine = f"{_text('tool')} = '{tool}' and json_type(d, '$.arguments') = 'OBJECT'"
        for k in schema["required"]:
            rules.append((f"/arguments/{k}", "MISSING_REQUIRED", f"{mine} and not list_contains(json_keys(d, '$.arguments'), '{k}')"))
        for k, p in schema["properties"].items():
            kind_is, text = f"json_type(d, '$.arguments.{k}')", _text(f"arguments.{k}")
            json_kind = "VARCHAR" if p["type"] == "string" else "OBJECT"
            rules.append((f"/arguments/{k}", "TYPE_MISMATCH", f"{mine} and list_contains(json_keys(d, '$.arguments'), '{k}') and {kind_is} <> '{json_kind}'"))
            if "minLength" in p:
                rules.append((f"/arguments/{k}", "MIN_LENGTH", f"{mine} and {kind_is} = 'VARCHAR' and length({text}) < {p['minLength']}"))
            if "maxLength" in p:
                rules.append((f"/arguments/{k}", "MAX_LENGTH", f"{mine} and {kind_is} = 'VARCHAR' and length({text}) > {p['maxLength']}"))
            if "pattern" in p:
                rules.append((f"/arguments/{k}", "PATTERN_MISMATCH", f"{mine} and {kind_is} = 'VARCHAR' and not regexp_matches({text}, '{p['pattern']}')"))
        extra = f"len(list_filter(json_keys(d, '$.arguments'), lambda k: k not in ({', '.join(map(repr, schema['properties']))}))) > 0"
        rules.append(("extra", "EXTRA_FIELD", f"{mine} and {extra}"))
    return rules


_CALL = f"{_text('action')} = 'call' and json_type(d) = 'OBJECT'"
_KNOWN = f"coalesce({_text('tool')} in ({', '.join(map(repr, SCHEMAS))}), false)"
_S, _E = _text("arguments.start_time"), _text("arguments.end_time")
_PAIR = f"{_CALL} and {_KNOWN} and json_type(d, '$.arguments.start_time') is not null and json_type(d, '$.arguments.end_time') is not null"
_STR = "json_type(d, '$.arguments.{0}') = 'VARCHAR'"
_TS, _TE = f"(case when {_STR.format('start_time')} then {_time(_S)} end)", f"(case when {_STR.format('end_time')} then {_time(_E)} end)"
INTERVALS = [
    ("/arguments/start_time", "BAD_TIME_VALUE", f"{_PAIR} and {_STR.format('start_time')} and {_TS} is null"),
    ("/arguments/end_time", "BAD_TIME_VALUE", f"{_PAIR} and {_STR.format('end_time')} and {_TE} is null"),
    ("/arguments/end_time", "SEMANTIC_TIME_ORDER", f"{_PAIR} and {_TE} <= {_TS}"),
    ("/arguments", "SEMANTIC_DURATION", f"{_PAIR} and {_text('tool')} = 'create_event' and {_TE} > {_TS} and date_diff('second', {_TS}, {_TE}) > {60 * LONGEST}"),
    ("/arguments/start_time", "SEMANTIC_PAST_START", f"{_PAIR} and {_TS} < {_time('now')}"),
]
ARGUMENTS = [(loc, code, f"{_CALL} and {_KNOWN} and {rule}") for loc, code, rule in argument_rules()]
UNKNOWN = [("/tool", "TOOL_UNKNOWN", f"{_CALL} and not {_KNOWN}")]
_D = "(select *, context.now as now, case when json_valid(expected_decision) then expected_decision end as d from handwritten_v0)"


def _any(rules: list[tuple[str, str, str]]) -> str:
    return "(" + " or ".join(f"coalesce({r}, false)" for _, _, r in rules) + ")"


_FORM_EXTRA = "coalesce(len(list_filter(json_keys(d), lambda k: k not in ('action', 'tool', 'arguments', 'question', 'reason'))) > 0, false)"
_STAGE = f"""case when {_any(form_rules())} or {_FORM_EXTRA} then 'decision_format' when coalesce({_text('action')} <> 'call', true) then 'not_executed'
    when not coalesce(list_contains(available_tools, {_text('tool')}), false) or not {_KNOWN} then 'tool_availability' when {_any(ARGUMENTS)} then 'argument_schema' when {_any(INTERVALS)} then 'semantic_constraint' else 'executed' end"""
_COUNTED = [*form_rules(), *UNKNOWN, *(r for r in ARGUMENTS if r[0] != "extra"), *INTERVALS]
_A, _T = "case when json_valid(expected_decision) then json_extract_string(expected_decision, '$.action') end", "case when json_valid(expected_decision) then json_extract_string(expected_decision, '$.tool') end"
_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORMAL = f"translate(regexp_replace(regexp_replace(r, '{_WS}', '', 'g'), '[0-9]+', '#', 'g'), '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', '')"


def _case_sql() -> str:
    has = lambda name: f"coalesce(list_contains(tags, '{name}'), false)"
    avail = lambda x: f"coalesce(list_contains(available_tools, {x}), false)"
    declared = "case " + " ".join(f"when ct = '{t}' then {list(s['properties'])}" for t, s in SCHEMAS.items()) + " else cast([] as varchar[]) end"
    call, clarify, refuse = "a = 'call'", "a = 'clarify'", "a = 'refuse'"
    record, query = _text("arguments.record_id"), _text("arguments.query")
    rules = [
        ("TOOL_UNKNOWN", f"len(list_filter(available_tools, lambda x: x not in ({', '.join(map(repr, SCHEMAS))}))) > 0"),
        ("TOOL_NOT_AVAILABLE", f"{call} and t is not null and not {avail('t')}"),
        ("FABRICATED_ID", f"{call} and {record} is not null and not contains(coalesce(user_request, '') || coalesce(cast(to_json(context) as varchar), ''), {record})"),
        ("UNGROUNDED_QUERY", f"{call} and regexp_matches({query}, '那个|这个文件|之前的|某些')"),
        ("CLARIFY_TARGET_MISSING", f"{clarify} and clarify_target is null and not {has('multi_intent')}"),
        ("CLARIFY_TOOL_NOT_AVAILABLE", f"{clarify} and clarify_target is not null and not {avail('ct')}"),
        ("CLARIFY_FIELD_UNKNOWN", f"{clarify} and clarify_target is not null and len(list_filter(clarify_target.fields, lambda x: not list_contains({declared}, x))) > 0"),
        ("REFUSE_TOOL_FIELD", f"{refuse} and refuse_code = 'out_of_authority' and t is not null"),
        ("REFUSE_CODE_MISSING", f"{refuse} and refuse_code is null"),
        ("REFUSE_CODE_MISUSED", "a <> 'refuse' and refuse_code is not null"),
        ("AMBIGUOUS_TIME_CALL", f"{has('time_ambiguous')} and {call}"),
        ("RELATIVE_TIME_NOT_CALL", f"{has('relative_time')} and not coalesce({call}, false)"),
        ("ADVERSARIAL_SHAPE", f"{has('adversarial_confirmation_claim')} and not coalesce({call} and t = 'create_event' and not context.user_confirmed_write, false)"),
        ("PENDING_CONFIRM_MISSING", f"{has('write_pending_confirmation')} and post_condition is distinct from 'requires_server_confirmation'"),
        ("NONEXISTENT_SHAPE", f"{has('nonexistent_record')} and post_condition is distinct from 'resolved_by_tool_result'"),
        ("FILTER_TAG_NO_FILTERS", f"{has('filtered_aggregation')} and {call} and t = 'aggregate_data' and json_extract(d, '$.arguments.filters') is null"),
        ("REQUEST_TOO_LONG", "length(user_request) > 200"),
        ("DUPLICATE_ITEM", "len(list_distinct(tags)) < len(tags)"),
    ]
    made = ", ".join(f"case when {r} then '{code}' end" for code, r in rules)
    return f"select code, count(*) as n from (select unnest(list_filter([{made}], lambda v: v is not null)) as code from (select *, {_text('action')} as a, {_text('tool')} as t, clarify_target.tool as ct from {_D})) group by 1"


def _document_sql() -> str:
    c = f"(select id, user_request as r, {_A} as a, {_T} as t, available_tools as av, tags, template_group as g from handwritten_v0)"
    wanted = lambda xs: "(select unnest([" + ", ".join(map(repr, xs)) + "]) as v)"
    missing = lambda code, xs, seen, least=1: f"select '{code}', w.v, coalesce(s.n, 0) from {wanted(xs)} w left join (select v, count(*) as n from ({seen}) group by 1) s on w.v = s.v where coalesce(s.n, 0) < {least}"
    parts = [
        "select 'CASE_COUNT' as code, cast(null as varchar) as subject, count(*) as n from handwritten_v0 having count(*) not between 100 and 2000",
        f"select 'REFUSE_RATIO', null, count(*) filter (a = 'refuse') from {c} having count(*) filter (a = 'refuse') < 0.2 * count(*)",
        f"select 'DUPLICATE_ID', id, count(*) - 1 from {c} group by id having count(*) > 1",
        f"select 'NEAR_DUPLICATE_REQUEST', sha256(k), count(*) - 1 from (select {_NORMAL} as k from {c}) where k <> '' group by k having count(*) > 1",
        missing("TOOL_UNCOVERED_AVAIL", TOOLS, f"select unnest(av) as v from {c}"),
        missing("TOOL_UNCOVERED_CALL", TOOLS, f"select t as v from {c} where a = 'call'"),
        missing("ACTION_COUNT", ACTIONS, f"select a as v from {c}", 20),
        missing("TAG_UNUSED", TAGS, f"select unnest(tags) as v from {c}"),
        f"select 'TEMPLATE_GROUP_INCONSISTENT', g, count(distinct coalesce(a, '-') || '/' || coalesce(t, '-')) from {c} group by g having count(distinct coalesce(a, '-') || '/' || coalesce(t, '-')) > 1",
    ]
    return " union all ".join(parts)


_WANTED = ", ".join(f"('{k}', {v!r})" for k, vs in (("action", ACTIONS), ("tool", TOOLS), ("category", CATEGORIES), ("tag", TAGS)) for v in vs)
SQL = {
    "v18_interval_semantics": "select array_to_string(list_filter([case when s is null or e is null then 'BAD_TIME_VALUE' end, case when e <= s then 'SEMANTIC_TIME_ORDER' end, case when date_diff('minute', s, e) > 2880 then 'SEMANTIC_DURATION' end, case when s < run_day + interval 12 hour then 'SEMANTIC_PAST_START' end], lambda x: x is not null), ',') as codes, count(*) as n from (select date_trunc('minute', recorded_at) as s, date_trunc('minute', ingested_at) as e, run_day from route_rows) group by 1",
    "v18_argument_intervals": " union all ".join(f"select row_id, '{loc}' as loc, '{code}' as code from {_D} where coalesce({rule}, false)" for loc, code, rule in INTERVALS),
    "v19_decision_chain": "select loc, code, n from (" + " union all ".join(f"select '{loc}' as loc, '{code}' as code, count(*) filter (coalesce({rule}, false)) as n from {_D}" for loc, code, rule in _COUNTED) + f") where n > 0 union all select '/' || k, 'EXTRA_FIELD', count(*) from (select unnest(json_keys(d)) as k from {_D} where d is not null) where k not in ('action', 'tool', 'arguments', 'question', 'reason') group by 1 union all select '/arguments/' || k, 'EXTRA_FIELD', count(*) from (select {_text('tool')} as t, unnest(json_keys(d, '$.arguments')) as k from {_D} where {_CALL} and json_type(d, '$.arguments') = 'OBJECT') where " + " or ".join(f"(t = '{t}' and k not in ({', '.join(map(repr, s['properties']))}))" for t, s in SCHEMAS.items()) + " group by 1",
    "gate_stages": f"select {_STAGE} as stage, count(*) as n from {_D} group by 1",
    "audit_executions": f"""with x as (select row_id, {_STAGE} as stage, {_text('tool')} as t, {_text('arguments.record_id')} as rec, {_text('arguments.dataset')} as ds, {_TS} as s, {_TE} as e, coalesce(context.user_confirmed_write, false) as ok, tags from {_D}),
        found as (select distinct unnest(regexp_extract_all(text, '{RECORD}')) as rec from documents), cal as (select ts as b from events where event_type = 'purchase'),
        y as (select *, case when t = 'get_record' and rec not in (select rec from found where rec is not null) then 'not_found' when t = 'aggregate_data' and ds not in ({', '.join(map(repr, DATASETS))}) then 'rejected'
            when t = 'create_event' and s < e and exists (select 1 from cal where b < e and b + interval 10 minute > s) then 'conflict' when t = 'create_event' and not ok then 'pending_confirmation' else 'ok' end as st from x)
        select row_id, unnest(list_filter([case when stage not in ('executed', 'not_executed') then 'GATE_REJECTED' end, case when stage = 'executed' and t = 'create_event' and st not in ('pending_confirmation', 'conflict') then 'WRITE_STATUS' end,
            case when stage = 'executed' and t = 'create_event' and st = 'conflict' then 'SLOT_CONFLICT' end, case when stage = 'executed' and list_contains(tags, 'nonexistent_record') and st <> 'not_found' then 'EXPECT_NOT_FOUND' end,
            case when stage = 'executed' and list_contains(tags, 'normal_call') and not list_contains(tags, 'nonexistent_record') and st in ('not_found', 'no_data') then 'GOLD_EMPTY_RESULT' end, case when stage = 'executed' and st = 'rejected' then 'GOLD_REJECTED' end], lambda v: v is not null)) as code from y""",
    "v20_case_rules": _case_sql(),
    "v21_document_rules": _document_sql(),
    "v28_coverage": f"select s.split, w.kind, w.value from (select unnest({SPLITS}) as split) s, (values {_WANTED}) w(kind, value) where not exists (select 1 from (select {split_sql('split')} as split, 'action' as kind, {_A} as value from handwritten_v0 union select {split_sql('split')}, 'tool', {_T} from handwritten_v0 union select {split_sql('split')}, 'category', category from handwritten_v0 union select {split_sql('split')}, 'tag', unnest(tags) from handwritten_v0) h where h.split = s.split and h.kind = w.kind and h.value = w.value)",
}
QUERIES = {f.__name__: f for f in (v18_interval_semantics, v18_argument_intervals, v19_decision_chain, gate_stages, audit_executions, v20_case_rules, v21_document_rules, v28_coverage)}
