"""The decision chain on small fixtures: nested intervals, the gate, executions, and rules that the tables don't break."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillmere.functions.jsonvalue import strict_json
from quillmere.operators.chain import case_codes, decision_errors, document_codes, execution_audit, gate, interval_errors

CONTRACT = {"type": "object", "required": ["action"], "properties": {"action": {"type": "string", "enum": ["call", "clarify", "refuse"]}, "tool": {"type": "string"}, "arguments": {"type": "object"}}, "additionalProperties": False}
SCHEMAS = {"create_event": {"type": "object", "required": ["title"], "properties": {"title": {"type": "string"}, "start_time": {"type": "string"}, "end_time": {"type": "string"}, "more": {"type": "object"}}, "additionalProperties": False}, "get_record": {"type": "object", "required": ["record_id"], "properties": {"record_id": {"type": "string", "pattern": "^R[0-9]$"}}, "additionalProperties": False}}
def given():
    return F.lit("2026-05-01T08:00"), CONTRACT, SCHEMAS, "create_event", 480


def codes(spark, docs, make):
    rows = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False) if not isinstance(d, str) else d) for i, d in enumerate(docs)], "i int, d string").withColumn("v", strict_json(F.col("d")))
    return [r["out"] for r in rows.select("i", make().alias("out")).orderBy("i").collect()]


def test_intervals_at_any_depth(spark):
    docs = [
        {"start_time": "2026-05-01T09:00", "end_time": "2026-05-01T10:00"},
        {"start_time": "2026-05-01T09:00", "end_time": "2026-05-01T09:00"},
        {"start_time": "2026-02-30T09:00", "end_time": "x"},
        {"start_time": "2026-05-01T07:00", "end_time": "2026-05-01T19:00"},
        {"a": {"b": {"start": "2026-05-02T09:00", "end": "2026-05-01T09:00"}}},
        {"start": "2026-05-03T00:00", "start_time": "2026-05-02T09:00", "end": "2026-05-02T08:00"},
        {"start_time": "2026-05-01T07:00"},
        {"start_time": 5, "end_time": None},
        {},
    ]
    got = codes(spark, docs, lambda: F.transform(interval_errors(F.col("d"), F.lit("create_event"), F.lit("2026-05-01T08:00"), "create_event", 480), lambda e: F.concat(e["loc"], F.lit(" "), e["code"])))
    a = "/arguments"
    assert got == [
        [], [f"{a}/end_time SEMANTIC_TIME_ORDER"], [f"{a}/start_time BAD_TIME_VALUE", f"{a}/end_time BAD_TIME_VALUE"], [f"{a} SEMANTIC_DURATION", f"{a}/start_time SEMANTIC_PAST_START"],
        [f"{a}/a/b/end SEMANTIC_TIME_ORDER"], [f"{a}/end SEMANTIC_TIME_ORDER"], [], [], [],
    ]


DECISIONS = [
    {"action": "call", "tool": "create_event", "arguments": {"title": "t", "start_time": "2026-05-01T09:00", "end_time": "2026-05-01T10:00"}},
    {"action": "call", "tool": "drop_table", "arguments": {}},
    {"action": "call", "tool": "get_record", "arguments": {"record_id": "R77", "x": 1}},
    {"action": "call", "tool": "get_record"},
    {"action": "call", "tool": "create_event", "arguments": {"title": "t", "start_time": "2026-05-01T09:00", "end_time": "2026-05-01T08:30"}},
    {"action": "refuse"},
    {"action": "dance"},
    "no json",
    {"action": "call", "tool": "get_record", "arguments": {"record_id": "R7"}},
]


def test_decision_chain(spark):
    got = codes(spark, DECISIONS, lambda: F.when(F.col("v").isNotNull(), F.transform(decision_errors(F.col("v"), *given()), lambda e: F.concat(e["loc"], F.lit(" "), e["code"]))))
    assert got == [[], ["/tool TOOL_UNKNOWN"], ["/arguments/x EXTRA_FIELD", "/arguments/record_id PATTERN_MISMATCH"], ["/arguments TYPE_MISMATCH"], ["/arguments/end_time SEMANTIC_TIME_ORDER"], [], ["/action ENUM_MISMATCH"], None, []]


def test_gate_stages(spark):
    got = codes(spark, DECISIONS, lambda: gate(F.col("v"), F.array(F.lit("create_event")), *given()))
    assert got == ["executed", "tool_availability", "tool_availability", "tool_availability", "semantic_constraint", "not_executed", "decision_format", "decision_format", "tool_availability"]
    got = codes(spark, DECISIONS, lambda: gate(F.col("v"), F.array(F.lit("get_record"), F.lit("create_event")), *given()))
    assert got[2:4] == ["argument_schema", "argument_schema"] and got[8] == "executed"


def test_execution_audit(spark):
    rows = [
        (1, "executed", "get_record", "R1", None, None, None, False, ["normal_call"]),
        (2, "executed", "get_record", "R9", None, None, None, False, ["normal_call"]),
        (3, "executed", "get_record", "R9", None, None, None, False, ["nonexistent_record", "normal_call"]),
        (4, "executed", "get_record", "R1", None, None, None, False, ["nonexistent_record"]),
        (5, "argument_schema", "get_record", None, None, None, None, False, None),
        (6, "not_executed", None, None, None, None, None, None, None),
        (7, "executed", "create_event", None, None, "2026-05-01 09:00:00", "2026-05-01 10:00:00", False, None),
        (8, "executed", "create_event", None, None, "2026-05-01 11:00:00", "2026-05-01 12:00:00", False, None),
        (9, "executed", "create_event", None, None, "2026-05-01 11:00:00", "2026-05-01 12:00:00", True, None),
        (10, "executed", "aggregate_data", None, "moon", None, None, False, None),
        (11, "executed", "aggregate_data", None, "orders", None, None, False, None),
    ]
    cases = spark.createDataFrame(rows, "key int, stage string, tool string, record_id string, dataset string, start string, end string, confirmed boolean, tags array<string>")
    cases = cases.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
    calendar = spark.createDataFrame([("2026-05-01 09:30:00", "2026-05-01 11:00:00")], "r_start string, r_end string").select(F.col("r_start").cast("timestamp_ntz").alias("r_start"), F.col("r_end").cast("timestamp_ntz").alias("r_end"))
    records = spark.createDataFrame([("R1",), ("R1",), (None,)], "record_id string")
    got = sorted(r[:] for r in execution_audit(cases, records, calendar, ["orders"], "create_event").collect())
    assert got == [(2, "GOLD_EMPTY_RESULT"), (4, "EXPECT_NOT_FOUND"), (5, "GATE_REJECTED"), (7, "SLOT_CONFLICT"), (9, "WRITE_STATUS"), (10, "GOLD_REJECTED")]


def test_case_rules_that_the_tables_keep(spark):
    schema = "i int, decision string, available array<string>, tags array<string>, target_tool string, target_fields array<string>, refuse_code string, blocking array<string>, confirmed boolean, post_condition string"
    rows = [
        (0, '{"action": "refuse"}', ["get_record"], [], None, None, "unavailable_tool", ["get_record"], False, None),
        (1, '{"action": "refuse"}', ["get_record"], [], None, None, "infeasible_time", ["create_event"], False, None),
        (2, '{"action": "refuse", "tool": "x"}', ["get_record"], [], None, None, "out_of_authority", None, False, None),
        (3, '{"action": "clarify"}', ["get_record"], ["multi_intent"], None, None, None, None, False, None),
        (4, '{"action": "clarify"}', ["get_record"], [], "get_record", ["title", "record_id"], None, None, False, None),
        (5, '{"action": "call", "tool": "create_event"}', ["create_event"], ["adversarial_confirmation_claim"], None, None, None, None, True, None),
        (6, '{"action": "call", "tool": "create_event"}', ["create_event"], ["adversarial_confirmation_claim", "time_ambiguous"], None, None, None, None, False, None),
        (7, '{"action": "call", "tool": "get_record", "arguments": {"query": "那个文件"}}', ["moon", "get_record"], [], None, None, None, None, False, None),
        (8, None, None, None, None, None, None, None, None, None),
    ]
    c = spark.createDataFrame(rows, schema)
    fields = {k: F.col(k) for k in ("decision", "available", "tags", "target_tool", "target_fields", "refuse_code", "blocking", "confirmed", "post_condition")} | {"request": F.lit("r"), "context": F.lit("{}"), "has_target": F.col("target_tool").isNotNull()}
    got = [r["c"] for r in c.select("i", case_codes(fields, SCHEMAS, "create_event").alias("c")).orderBy("i").collect()]
    assert got == [["BLOCKING_TOOL_AVAILABLE"], ["BLOCKING_TOOL_MISUSE"], ["REFUSE_TOOL_FIELD"], [], ["CLARIFY_FIELD_UNKNOWN"], ["ADVERSARIAL_SHAPE"], ["AMBIGUOUS_TIME_CALL"], ["TOOL_UNKNOWN", "UNGROUNDED_QUERY"], []]


def test_document_rules_of_few_cases(spark):
    rows = [("a", "查 1 号", "call", "t1", ["t1"], ["x"], "g"), ("a", "查 2 号。", "refuse", None, ["t1"], None, "g"), ("b", None, None, None, None, None, None)]
    cases = spark.createDataFrame(rows, "id string, request string, action string, tool string, available array<string>, tags array<string>, template_group string")
    got = {(r["code"], r["subject"], r["n"]) for r in document_codes(cases, ["t1", "t2"], ["call", "refuse"], ["x", "y"], (5, 9), 1, 0.5).collect()}
    assert {(c, s) for c, s, _ in got if c != "NEAR_DUPLICATE_REQUEST"} == {("CASE_COUNT", None), ("REFUSE_RATIO", None), ("DUPLICATE_ID", "a"), ("TOOL_UNCOVERED_AVAIL", "t2"), ("TOOL_UNCOVERED_CALL", "t2"), ("TAG_UNUSED", "y"), ("TEMPLATE_GROUP_INCONSISTENT", "g")}
    assert [n for c, _, n in got if c == "NEAR_DUPLICATE_REQUEST"] == [1]
    assert {r["code"] for r in document_codes(cases.where("false"), ["t1"], [], [], (0, 9), 1, 0.5).collect()} == {"TOOL_UNCOVERED_AVAIL", "TOOL_UNCOVERED_CALL"}
