"""Lints of the documents that contracts are made of: tools, their registry, the decision contract, the case schema, the prompt.

They run on the driver, as a handful of documents is bounded by the project and not by its data, and give (place, code)
pairs.  ``group_design`` lints template groups, which are data, as a column.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.operators.contracts import lint, nodes

Fault = tuple[str, str]
_CJK = re.compile("[一-鿿]")
#: Who may confirm a write, and the start of a pattern of minute timestamps.
CONFIRMER, TIME_START = "server_session", r"^\d{4}"


def _faults(*checks: tuple[bool, str, str]) -> list[Fault]:
    return [(place, code) for bad, place, code in checks if bad]


def parameters(schema: object, at: str = "") -> Iterator[tuple[str, dict]]:
    """(place, schema) of every declared parameter, those of nested objects and of items included."""
    for place, node in nodes(schema) if isinstance(schema, dict) else []:
        if isinstance(node, dict):
            if place.startswith("/properties/"):
                yield at + place, node
            if place.startswith("/properties/") or place == "/items":
                yield from parameters(node, at + place)


def patterns(schema: object) -> list[str]:
    """All patterns in a schema, in the order of a walk."""
    if not isinstance(schema, dict):
        return []
    own = [schema["pattern"]] if isinstance(schema.get("pattern"), str) else []
    return own + [p for _, node in nodes(schema) for p in patterns(node)]


def tool_lint(doc: object, name: str) -> list[Fault]:
    """A tool's document: its name, a description of 20 to 200 characters in one line with Chinese in it, whether it writes and who
    confirms that, a strict object of parameters each of which is described."""
    if not isinstance(doc, dict):
        return [("#", "TOOL_DOC")]
    text, run, schema = doc.get("description"), doc.get("execution"), doc.get("input_schema")
    out = _faults(
        (set(doc) != {"name", "description", "execution", "input_schema"}, "#", "TOOL_TOP_FIELDS"),
        (doc.get("name") != name or not re.fullmatch("[a-z][a-z0-9_]{2,40}", str(doc.get("name"))), "#/name", "TOOL_NAME"),
        (not isinstance(text, str) or not 20 <= len(text) <= 200, "#/description", "TOOL_DESC_LEN"),
        (isinstance(text, str) and "\n" in text, "#/description", "TOOL_DESC_NEWLINE"),
        (isinstance(text, str) and not _CJK.search(text), "#/description", "TOOL_DESC_LANG"),
    )
    if not isinstance(run, dict) or not {"side_effect", "requires_server_confirmation"} <= set(run) <= {"side_effect", "requires_server_confirmation", "confirmation_source"}:
        out.append(("#/execution", "TOOL_EXEC_KEYS"))
    else:
        writes, asks = run["side_effect"] == "write", run["requires_server_confirmation"]
        out += _faults(
            (run["side_effect"] not in ("read_only", "write"), "#/execution/side_effect", "TOOL_EXEC_SIDE_EFFECT"),
            (not isinstance(asks, bool) or asks != writes, "#/execution/requires_server_confirmation", "TOOL_EXEC_CONFIRM"),
            (run.get("confirmation_source") != (CONFIRMER if asks else None), "#/execution/confirmation_source", "TOOL_EXEC_SOURCE"),
        )
    if not isinstance(schema, dict) or schema.get("type") != "object" or not isinstance(schema.get("properties"), dict) or not schema["properties"]:
        return [*out, ("#/input_schema", "TOOL_SCHEMA_ROOT")]
    required = schema.get("required", [])
    out += _faults(
        (schema.get("additionalProperties") is not False, "#/input_schema/additionalProperties", "TOOL_SCHEMA_STRICT"),
        (isinstance(required, list) and not set(required) <= set(schema["properties"]), "#/input_schema/required", "TOOL_SCHEMA_REQUIRED"),
    )
    out += lint(schema, "#/input_schema")
    for place, node in parameters(schema):
        said = node.get("description")
        out += _faults((not isinstance(said, str) or len(said) < 8 or not _CJK.search(said), f"#/input_schema{place}/description", "ARG_DESC"))
    return out


def registry_lint(schemas: Mapping[str, object], expected: Iterable[str], time_pattern: str) -> list[Fault]:
    """The tools are those expected, and all patterns of timestamps are one and the same."""
    odd = sorted({p for s in schemas.values() for p in patterns(s) if p.startswith(TIME_START) and p != time_pattern})
    return _faults((set(schemas) != set(expected), "#", "TOOL_SET"), (bool(odd), "#", "TIME_PATTERN_DRIFT"))


def decision_lint(schema: object, tools: Iterable[str], branches: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> list[Fault]:
    """A decision contract: strict, requires the action alone, knows the tools, and says of each action which fields it has and which it mustn't have.

    ``branches``: action -> (fields that it needs, fields that it forbids).
    """
    if not isinstance(schema, dict) or schema.get("type") != "object":
        return [("#", "DECISION_SCHEMA_ROOT")]
    properties = schema.get("properties", {})
    fields = {"action", *(f for need, deny in branches.values() for f in (*need, *deny))}
    inside = lambda name: properties.get(name) if isinstance(properties.get(name), dict) else {}
    out = lint(schema) + _faults(
        (schema.get("additionalProperties") is not False, "#/additionalProperties", "DECISION_NOT_STRICT"),
        (schema.get("required") != ["action"], "#/required", "DECISION_REQUIRED"),
        (set(properties) != fields, "#/properties", "DECISION_FIELDS"),
        (inside("action").get("enum") != list(branches), "#/properties/action/enum", "DECISION_ACTIONS"),
        (set(inside("tool").get("enum") or ()) != set(tools), "#/properties/tool/enum", "DECISION_TOOL_ENUM"),
        ("additionalProperties" in inside("arguments"), "#/properties/arguments", "ARGUMENTS_OVERCONSTRAINED"),
    )
    found: dict[str, dict] = {}
    for branch in schema.get("allOf", []) if isinstance(schema.get("allOf", []), list) else []:
        if isinstance(branch, dict) and isinstance(branch.get("if"), dict):
            const = branch["if"].get("properties", {}).get("action", {}).get("const")
            if const in branches:
                found[const] = branch.get("then") or {}
    out += _faults((set(found) != set(branches), "#/allOf", "DECISION_BRANCHES"))
    for action, then in found.items():
        need, deny = branches[action]
        denied = {x for clause in (then.get("not") or {}).get("anyOf", []) for x in clause.get("required", [])}
        out += _faults(
            (set(then.get("required", [])) - {"action"} != set(need), f"#/allOf/{action}", "DECISION_BRANCH_REQUIRED"),
            (denied != set(deny), f"#/allOf/{action}", "DECISION_BRANCH_NOT"),
        )
    return out


def inject(node: object, reference: str, schema: dict) -> object:
    """A copy of a document in which every node that refers to a contract (``x-contract-ref``) is that contract's schema."""
    if isinstance(node, dict):
        return copy.deepcopy(schema) if node.get("x-contract-ref") == reference else {k: inject(v, reference, schema) for k, v in node.items()}
    return [inject(x, reference, schema) for x in node] if isinstance(node, list) else node


def case_schema_lint(schema: object, glossary: Iterable[str], fields: Iterable[str], tools: Mapping[str, dict], reference: str) -> list[Fault]:
    """The schema of cases: strict, its tags those of the glossary, its fields described in Chinese, its enums those of the tools, and a place for the decision contract."""
    if not isinstance(schema, dict) or not isinstance(schema.get("properties"), dict):
        return [("#", "CASE_SCHEMA_ROOT")]
    properties = schema["properties"]
    enum = lambda *path: set(_at(properties, path).get("enum") or ())
    known = {k for s in tools.values() for k in s.get("properties", {})}
    out = _faults(
        (schema.get("additionalProperties") is not False, "#/additionalProperties", "CASE_SCHEMA_STRICT"),
        (enum("tags", "items") != set(glossary), "#/properties/tags/items/enum", "TAG_GLOSSARY"),
        (enum("clarify_target", "properties", "fields", "items") != known, "#/properties/clarify_target/properties/fields/items/enum", "CLARIFY_FIELD_ENUM"),
        (enum("available_tools", "items") != set(tools), "#/properties/available_tools/items/enum", "CASE_TOOL_ENUM"),
        (inject(schema, reference, {}) == schema, "#/properties/expected_decision", "REF_NOT_INJECTED"),
    )
    for f in fields:
        if f not in properties:
            out.append((f"#/properties/{f}", "CASE_FIELD"))
        elif not _CJK.search(str(_at(properties, (f,)).get("description") or "")):
            out.append((f"#/properties/{f}/description", "CASE_FIELD_DESC"))
    return out


def _at(node: object, path: Sequence[str]) -> dict:
    for p in path:
        node = node.get(p) if isinstance(node, dict) else None
    return node if isinstance(node, dict) else {}


def estimated_tokens(text: str) -> int:
    """One per ideograph and one per four other characters, rounded up: ``functions.text.estimate_tokens`` for one text on the driver."""
    cjk = len(_CJK.findall(text))
    return cjk + (len(text) - cjk + 3) // 4


def prompt_lint(prompt: str, docs: Sequence[dict], budget: int, hidden: Sequence[str], hints: Sequence[str]) -> list[Fault]:
    """A rendered block of tools: within its budget of tokens, with every tool, parameter, choice and hint in it, and without fields of the server."""
    terms = {d["name"] for d in docs} | set(hints)
    for d in docs:
        for place, node in parameters(d["input_schema"]):
            terms |= {place.rsplit("/", 1)[-1], *map(str, node.get("enum", []))}
    out = _faults((estimated_tokens(prompt) > budget, "#", "PROMPT_BUDGET"))
    out += [(t, "PROMPT_INFO_LOSS") for t in sorted(terms) if t not in prompt]
    return out + [(h, "PROMPT_LEAK") for h in hidden if h in prompt]


def widened(doc: dict, deltas: Sequence[Mapping]) -> dict:
    """A document with the registered differences applied: ``{"path": "a.b", "add": [...]}`` adds to a list what it lacks,
    ``{"path": "a.b", "add_entries": {...}}`` sets keys of an object.  Anything else is an error."""
    out = copy.deepcopy(doc)
    for d in deltas:
        node: object = out
        for part in d["path"].split("."):
            node = node[part]  # type: ignore[index]
        if set(d) == {"path", "add"} and isinstance(node, list):
            node += [x for x in d["add"] if x not in node]
        elif set(d) == {"path", "add_entries"} and isinstance(node, dict):
            node.update(copy.deepcopy(d["add_entries"]))
        else:
            raise ValueError(f"not a registered difference: {d}")
    return out


def delta_drift(base: dict, deltas: Sequence[Mapping], held_out: dict) -> list[Fault]:
    """Where a held-out contract isn't the base with the registered differences: the paths that differ."""
    return [(path, "UNSEEN_DELTA_DRIFT") for path in different_paths(widened(base, deltas), held_out)]


def different_paths(a: object, b: object, at: str = "") -> list[str]:
    """Paths at which two JSON trees differ, in the order of names: the place of a value, of a key that one side lacks, of a list's item or length."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in sorted(a.keys() | b.keys()):
            out += different_paths(a[k], b[k], f"{at}/{k}") if k in a and k in b else [f"{at}/{k}"]
        return out
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [p for i, (x, y) in enumerate(zip(a, b, strict=True)) for p in different_paths(x, y, f"{at}/{i}")]
    return [] if type(a) is type(b) and a == b else [at or "/"]


def group_design(g: Mapping[str, Column], tools: Sequence[str], held_out: Sequence[str], unseen_split: str = "unseen_test", unseen_set: str = "unseen2") -> Column:
    """Codes of a template group's design.  ``g``: split, toolset, action, tool, offered (all tools of its pool), target_tool, refuse_code, blocking, phrasings.

    A toolset for held-out data goes with its split and the reverse, held-out tools stay in it, what a group calls or asks
    about is on offer, what blocks it isn't, and it has two phrasings or more, all different.
    """
    out_of = lambda values, names: F.arrays_overlap(values, F.array(*(F.lit(n) for n in names)).cast("array<string>"))
    unseen = g["toolset"] == unseen_set
    unavailable = (g["action"] == "refuse") & (g["refuse_code"] == "unavailable_tool")
    rules = [
        (unseen & (g["split"] != unseen_split), "UNSEEN_SPLIT"),
        (~unseen & (g["split"] == unseen_split), "SPLIT_MISUSE"),
        (~unseen & (g["tool"].isin(*held_out) | out_of(g["offered"], held_out)), "UNSEEN_LEAK"),
        (unavailable & out_of(g["blocking"], held_out), "BLOCKING_LEAK"),
        (unavailable & (F.coalesce(F.size(g["blocking"]), F.lit(0)) <= 0), "BLOCKING_MISSING"),
        ((g["action"] == "refuse") & F.arrays_overlap(g["blocking"], g["offered"]), "BLOCKING_AVAILABLE"),
        ((g["action"] == "call") & ~F.coalesce(F.array_contains(g["offered"], g["tool"]), F.lit(False)), "TOOL_NOT_OFFERED"),
        (g["target_tool"].isNotNull() & ~F.coalesce(F.array_contains(g["offered"], g["target_tool"]), F.lit(False)), "TARGET_NOT_OFFERED"),
        (F.size(F.array_except(g["offered"], F.array(*(F.lit(t) for t in (*tools, *held_out))))) > 0, "TOOL_UNKNOWN"),
        (F.coalesce(F.size(g["phrasings"]), F.lit(0)) < 2, "GROUP_TOO_SMALL"),
        (F.size(F.array_distinct(g["phrasings"])) < F.size(g["phrasings"]), "PHRASING_REPEATED"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for bad, code in rules)))
