"""Lints of contracts: a sound document of each kind, and one with each fault."""

from __future__ import annotations

import copy

import pytest
from pyspark.sql import functions as F

from quillmere.operators.lints import case_schema_lint, decision_lint, delta_drift, different_paths, estimated_tokens, group_design, inject, parameters, patterns, prompt_lint, registry_lint, tool_lint, widened

TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"
TOOL = {
    "name": "find_room",
    "description": "按开始时间和人数查找一间空闲的会议室，返回房间编号和楼层。",
    "execution": {"side_effect": "read_only", "requires_server_confirmation": False},
    "input_schema": {
        "type": "object", "required": ["start"], "additionalProperties": False,
        "properties": {"start": {"type": "string", "pattern": TIME, "description": "会议开始的具体时间"}, "who": {"type": "array", "description": "参加会议的人员名单", "items": {"type": "object", "properties": {"rank": {"enum": ["甲", "乙"], "description": "该人员的职务级别"}}}}},
    },
}


def changed(doc, path, value):
    out = copy.deepcopy(doc)
    node = out
    *outer, last = path.split(".")
    for p in outer:
        node = node[p]
    if value is KeyError:
        del node[last]
    else:
        node[last] = value
    return out


def test_sound_tool():
    assert tool_lint(TOOL, "find_room") == []
    assert [p for p, _ in parameters(TOOL["input_schema"])] == ["/properties/start", "/properties/who", "/properties/who/items/properties/rank"]
    assert patterns(TOOL["input_schema"]) == [TIME]


@pytest.mark.parametrize(
    ("path", "value", "code"),
    [
        ("name", "FindRoom", "TOOL_NAME"), ("description", "短", "TOOL_DESC_LEN"), ("description", "x" * 40, "TOOL_DESC_LANG"), ("description", "会议室\n" * 10, "TOOL_DESC_NEWLINE"), ("extra", 1, "TOOL_TOP_FIELDS"),
        ("execution", {}, "TOOL_EXEC_KEYS"), ("execution.side_effect", "maybe", "TOOL_EXEC_SIDE_EFFECT"), ("execution.side_effect", "write", "TOOL_EXEC_CONFIRM"), ("execution.confirmation_source", "user", "TOOL_EXEC_SOURCE"),
        ("input_schema", [], "TOOL_SCHEMA_ROOT"), ("input_schema.properties", {}, "TOOL_SCHEMA_ROOT"), ("input_schema.additionalProperties", True, "TOOL_SCHEMA_STRICT"), ("input_schema.required", ["end"], "TOOL_SCHEMA_REQUIRED"),
        ("input_schema.minimum", 3, "UNSUPPORTED_KEYWORD"), ("input_schema.properties.start.pattern", "(", "BAD_PATTERN"), ("input_schema.properties.start.description", "when", "ARG_DESC"), ("input_schema.properties.who.items.properties.rank.description", KeyError, "ARG_DESC"),
    ],
)
def test_faulty_tools(path, value, code):
    assert code in [c for _, c in tool_lint(changed(TOOL, path, value), "find_room")]


def test_registry():
    schemas = {"find_room": TOOL["input_schema"]}
    assert registry_lint(schemas, ["find_room"], TIME) == []
    assert {c for _, c in registry_lint(schemas, ["book_room"], r"^\d{4}$")} == {"TOOL_SET", "TIME_PATTERN_DRIFT"}


BRANCHES = {"call": (["tool", "arguments"], ["question"]), "clarify": (["question"], ["tool", "arguments"])}
DECISION = {
    "type": "object", "required": ["action"], "additionalProperties": False,
    "properties": {"action": {"enum": ["call", "clarify"]}, "tool": {"enum": ["find_room"]}, "arguments": {"type": "object"}, "question": {"type": "string"}},
    "allOf": [{"if": {"properties": {"action": {"const": a}}}, "then": {"required": ["action", *need], "not": {"anyOf": [{"required": [d]} for d in deny]}}} for a, (need, deny) in BRANCHES.items()],
}


def test_decision_contract():
    assert decision_lint(DECISION, ["find_room"], BRANCHES) == []
    faults = [("additionalProperties", True, "DECISION_NOT_STRICT"), ("required", [], "DECISION_REQUIRED"), ("properties.extra", {}, "DECISION_FIELDS"), ("properties.action.enum", ["call"], "DECISION_ACTIONS"), ("properties.tool.enum", [], "DECISION_TOOL_ENUM"), ("properties.arguments.additionalProperties", False, "ARGUMENTS_OVERCONSTRAINED"), ("allOf", [], "DECISION_BRANCHES"), ("type", "array", "DECISION_SCHEMA_ROOT")]
    for path, value, code in faults:
        assert code in [c for _, c in decision_lint(changed(DECISION, path, value), ["find_room"], BRANCHES)]
    weaker = copy.deepcopy(DECISION)
    weaker["allOf"][0]["then"] = {"required": ["tool"]}
    assert {("#/allOf/call", "DECISION_BRANCH_REQUIRED"), ("#/allOf/call", "DECISION_BRANCH_NOT")} <= set(decision_lint(weaker, ["find_room"], BRANCHES))


def test_case_schema_and_references():
    schema = {
        "type": "object", "additionalProperties": False,
        "properties": {"tags": {"description": "标签", "items": {"enum": ["x"]}}, "available_tools": {"items": {"enum": ["find_room"]}}, "clarify_target": {"properties": {"fields": {"items": {"enum": ["start", "who"]}}}}, "expected_decision": {"x-contract-ref": "decision"}},
    }
    tools = {"find_room": TOOL["input_schema"]}
    assert case_schema_lint(schema, ["x"], ["tags"], tools, "decision") == []
    assert inject(schema, "decision", DECISION)["properties"]["expected_decision"] == DECISION and "x-contract-ref" in schema["properties"]["expected_decision"]
    assert {c for _, c in case_schema_lint(inject(schema, "decision", DECISION) | {"additionalProperties": True}, ["y"], ["seed", "available_tools"], {"t": {}}, "decision")} == {"CASE_SCHEMA_STRICT", "TAG_GLOSSARY", "CLARIFY_FIELD_ENUM", "CASE_TOOL_ENUM", "REF_NOT_INJECTED", "CASE_FIELD", "CASE_FIELD_DESC"}
    assert case_schema_lint([], [], [], {}, "r") == [("#", "CASE_SCHEMA_ROOT")]


def test_prompt():
    prompt = "find_room(start: YYYY, who[rank: 甲|乙])"
    assert prompt_lint(prompt, [TOOL], 20, ["side_effect"], ["YYYY"]) == []
    assert prompt_lint("find_room start side_effect 甲", [TOOL], 3, ["side_effect"], []) == [("#", "PROMPT_BUDGET"), ("rank", "PROMPT_INFO_LOSS"), ("who", "PROMPT_INFO_LOSS"), ("乙", "PROMPT_INFO_LOSS"), ("side_effect", "PROMPT_LEAK")]
    assert estimated_tokens("会议ab12x") == 4


def test_registered_differences():
    base = {"a": {"enum": [1]}, "m": {"k": [1]}}
    deltas = [{"path": "a.enum", "add": [1, 2]}, {"path": "m", "add_entries": {"n": [3]}}]
    assert widened(base, deltas) == {"a": {"enum": [1, 2]}, "m": {"k": [1], "n": [3]}} and base["a"]["enum"] == [1]
    assert delta_drift(base, deltas, widened(base, deltas)) == []
    assert delta_drift(base, deltas, base) == [("/a/enum", "UNSEEN_DELTA_DRIFT"), ("/m/n", "UNSEEN_DELTA_DRIFT")]
    with pytest.raises(ValueError, match="registered"):
        widened(base, [{"path": "a", "remove": ["enum"]}])
    assert different_paths({"a": [1, {"b": 2}], "c": True}, {"a": [1, {"b": 3}], "c": 1, "d": None}) == ["/a/1/b", "/c", "/d"] and different_paths([1], [1, 2]) == ["/"]


def test_group_design(spark):
    rows = [
        ("train", "unseen2", "call", "a", ["a"], None, None, None, ["x", "y"], ["UNSEEN_SPLIT"]),
        ("unseen_test", "train6", "call", "a", ["a"], None, None, None, ["x", "y"], ["SPLIT_MISUSE"]),
        ("train", "train6", "call", "h", ["a", "h"], None, None, None, ["x", "y"], ["UNSEEN_LEAK"]),
        ("train", "train6", "refuse", None, ["a"], None, "unavailable_tool", ["h"], ["x", "y"], ["BLOCKING_LEAK"]),
        ("train", "train6", "refuse", None, ["a"], None, "unavailable_tool", None, ["x", "y"], ["BLOCKING_MISSING"]),
        ("train", "train6", "refuse", None, ["a"], None, "other", ["a"], ["x", "y"], ["BLOCKING_AVAILABLE"]),
        ("train", "train6", "call", "b", ["a"], None, None, None, ["x", "x"], ["TOOL_NOT_OFFERED", "PHRASING_REPEATED"]),
        ("train", "train6", "clarify", None, ["a", "zz"], "b", None, None, ["x"], ["TARGET_NOT_OFFERED", "TOOL_UNKNOWN", "GROUP_TOO_SMALL"]),
        (None, None, None, None, None, None, None, None, None, ["GROUP_TOO_SMALL"]),
    ]
    g = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, split string, toolset string, action string, tool string, offered array<string>, target_tool string, refuse_code string, blocking array<string>, phrasings array<string>, want array<string>")
    fields = {k: F.col(k) for k in ("split", "toolset", "action", "tool", "offered", "target_tool", "refuse_code", "blocking", "phrasings")}
    for r in g.select("i", "want", group_design(fields, ["a", "b"], ["h"]).alias("got")).collect():
        assert r["got"] == r["want"], r
