"""JSON-Schema subset -> one column that holds every violation of a document.

``compile_schema`` walks a schema once on the driver and gives an expression over a VARIANT column: an array of
(location, code) in the order of a depth-first walk.  Bounded by the schema, not by the data, so it is one projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the keywords that a schema may use.
KEYWORDS = {
    "type", "const", "enum", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "items", "required", "properties",
    "additionalProperties", "minProperties", "allOf", "anyOf", "not", "if", "then", "else", "description", "title",
}
ERROR = "struct<loc:string,code:string>"
_TYPES = {"object": "OBJECT<", "array": "ARRAY<", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}


def lint(schema: object, at: str = "#") -> list[tuple[str, str]]:
    """Faults of a schema itself: UNSUPPORTED_KEYWORD, BAD_PATTERN, BAD_SCHEMA_NODE."""
    if isinstance(schema, bool):
        return []
    if not isinstance(schema, dict):
        return [(at, "BAD_SCHEMA_NODE")]
    out = [(f"{at}/{k}", "UNSUPPORTED_KEYWORD") for k in schema if k not in KEYWORDS]
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except (re.error, TypeError):
            out.append((f"{at}/pattern", "BAD_PATTERN"))
    for k, wanted in (("required", list), ("enum", list), ("allOf", list), ("anyOf", list), ("properties", dict)):
        if not isinstance(schema.get(k, wanted()), wanted):
            out.append((f"{at}/{k}", "BAD_SCHEMA_NODE"))
    for where, node in nodes(schema):
        out += lint(node, at + where)
    return out


def nodes(schema: dict) -> list[tuple[str, object]]:
    """(place, schema) of the schemas directly inside one."""
    out: list[tuple[str, object]] = [(f"/{k}", schema[k]) for k in ("items", "not", "if", "then", "else") if k in schema]
    if isinstance(schema.get("additionalProperties"), dict):
        out.append(("/additionalProperties", schema["additionalProperties"]))
    for k in ("allOf", "anyOf"):
        if isinstance(schema.get(k), list):
            out += [(f"/{k}/{i}", s) for i, s in enumerate(schema[k])]
    if isinstance(schema.get("properties"), dict):
        out += [(f"/properties/{k}", s) for k, s in schema["properties"].items()]
    return out


def _error(loc: Column | str, code: str) -> Column:
    return F.struct((F.lit(loc) if isinstance(loc, str) else loc).alias("loc"), F.lit(code).alias("code"))


def _none() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _when(bad: Column, loc: str, code: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_error(loc, code))).otherwise(_none())


def _all(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def kind(v: Column) -> Column:
    """JSON type of a VARIANT: object, array, string, integer, number, boolean or null."""
    s = F.schema_of_variant(v)
    return (
        F.when(F.startswith(s, F.lit("OBJECT")), "object")
        .when(F.startswith(s, F.lit("ARRAY")), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "BIGINT", "integer")
        .when(F.startswith(s, F.lit("DECIMAL")) | s.isin("DOUBLE", "FLOAT"), "number")
        .when(s == "VOID", "null")
    )


def _is(t: Column, names: str | list[str]) -> Column:
    wanted = [names] if isinstance(names, str) else list(names)
    if "number" in wanted:
        wanted.append("integer")
    return F.coalesce(t.isin(*wanted), F.lit(False))


def _equals(v: Column, t: Column, value: object) -> Column:
    if isinstance(value, bool):
        return _is(t, "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return _is(t, "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))
    if value is None:
        return _is(t, "null")
    return _is(t, "string") & (F.try_variant_get(v, "$", "string") == F.lit(value))


def _key(name: str) -> str:
    return f"$['{name}']"


def compile_schema(schema: dict, v: Column, at: str = "") -> Column:
    """Errors of the VARIANT ``v``, which must not be null."""
    faults = lint(schema)
    if faults:
        raise ValueError(f"bad schema: {faults}")
    return _compile(schema, v, at)


def _keys(v: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))


def _compile(schema: dict, v: Column, at: str) -> Column:
    """Errors of one node.  Its type, and its keys if they matter, are bound to a variable, so they are found once."""
    keyed = bool({"required", "minProperties"} & schema.keys()) or schema.get("additionalProperties", True) is not True
    t = kind(v)
    fields = [v.alias("v"), t.alias("t")]
    if keyed:
        fields.append(F.when(t == "object", _keys(v)).alias("k"))
    return F.transform(F.array(F.struct(*fields)), lambda s: _node(schema, s["v"], s["t"], s["k"] if keyed else None, at))[0]


def _node(schema: dict, v: Column, t: Column, keys: Column | None, at: str) -> Column:
    loc = at or "/"
    checks: list[Column] = []
    string = F.try_variant_get(v, "$", "string")
    if "const" in schema:
        checks.append(_when(~_equals(v, t, schema["const"]), loc, "CONST_MISMATCH"))
    if "enum" in schema:
        hit = F.lit(False)
        for x in schema["enum"]:
            hit = hit | F.coalesce(_equals(v, t, x), F.lit(False))
        checks.append(_when(~hit, loc, "ENUM_MISMATCH"))
    text = _is(t, "string")
    if "minLength" in schema:
        checks.append(_when(text & (F.length(string) < schema["minLength"]), loc, "MIN_LENGTH"))
    if "maxLength" in schema:
        checks.append(_when(text & (F.length(string) > schema["maxLength"]), loc, "MAX_LENGTH"))
    if "pattern" in schema:
        checks.append(_when(text & ~string.rlike("(?U)" + schema["pattern"]), loc, "PATTERN_MISMATCH"))
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    array = _is(t, "array")
    if "minItems" in schema:
        checks.append(_when(array & (F.size(items) < schema["minItems"]), loc, "MIN_ITEMS"))
    if "maxItems" in schema:
        checks.append(_when(array & (F.size(items) > schema["maxItems"]), loc, "MAX_ITEMS"))
    if schema.get("uniqueItems"):
        texts = F.transform(items, lambda x: F.to_json(x))
        checks.append(_when(array & (F.size(F.array_distinct(texts)) < F.size(texts)), loc, "DUPLICATE_ITEM"))
    if "items" in schema and schema["items"] is not True:
        each = F.transform(items, lambda x, i: F.transform(_compile(schema["items"], x, ""), lambda e: F.struct(F.concat(F.lit(f"{at}/"), i.cast("string"), F.when(e["loc"] != "/", e["loc"]).otherwise(F.lit(""))).alias("loc"), e["code"].alias("code"))))
        checks.append(F.when(array, F.flatten(each)).otherwise(_none()))
    whole = _is(t, "object")
    properties = schema.get("properties", {})
    if keys is not None:
        for name in schema.get("required", []):
            checks.append(_when(whole & ~F.array_contains(keys, name), f"{at}/{name}", "MISSING_REQUIRED"))
        if schema.get("additionalProperties") is False:
            extra = F.array_sort(F.array_except(keys, F.array(*(F.lit(k) for k in properties)).cast("array<string>")))
            checks.append(F.when(whole, F.transform(extra, lambda k: _error(F.concat(F.lit(f"{at}/"), k), "EXTRA_FIELD"))).otherwise(_none()))
        elif isinstance(schema.get("additionalProperties"), dict):
            # values of undeclared keys by one schema: the object as a map, each error below its key
            others = F.map_filter(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, _: ~k.isin(*properties) if properties else F.lit(True))
            each = F.transform(F.map_entries(others), lambda e: F.transform(_compile(schema["additionalProperties"], e["value"], ""), lambda x: F.struct(F.concat(F.lit(f"{at}/"), e["key"], F.when(x["loc"] != "/", x["loc"]).otherwise(F.lit(""))).alias("loc"), x["code"].alias("code"))))
            checks.append(F.when(whole, F.flatten(each)).otherwise(_none()))
        if "minProperties" in schema:
            checks.append(_when(whole & (F.size(keys) < schema["minProperties"]), loc, "MIN_PROPERTIES"))
    for name, sub in properties.items():
        if sub is not True:
            child = F.try_variant_get(v, _key(name), "variant")
            checks.append(F.when(whole & child.isNotNull(), _compile(sub, child, f"{at}/{name}")).otherwise(_none()))
    for sub in schema.get("allOf", []):
        checks.append(_compile(sub, v, at))
    if "anyOf" in schema:
        fine = F.lit(False)
        for sub in schema["anyOf"]:
            fine = fine | (F.size(_compile(sub, v, at)) == 0)
        checks.append(_when(~fine, loc, "ANY_OF_FAILED"))
    if "not" in schema:
        checks.append(_when(F.size(_compile(schema["not"], v, at)) == 0, loc, "FIELD_NOT_ALLOWED"))
    if "if" in schema:
        holds = F.size(_compile(schema["if"], v, at)) == 0
        yes = _compile(schema["then"], v, at) if "then" in schema else _none()
        no = _compile(schema["else"], v, at) if "else" in schema else _none()
        checks.append(F.when(holds, yes).otherwise(no))
    rest = _all(checks)
    if "type" in schema:
        return F.when(_is(t, schema["type"]), rest).otherwise(F.array(_error(loc, "TYPE_MISMATCH")))
    return rest


def interval_faults(start: Column, end: Column, now: Column | None, most_minutes: int | None) -> Column:
    """Codes of an interval of minute timestamps: unreadable, not after its start, too long, in the past."""
    from quillmere.functions.text import time_value

    s, e = time_value(start), time_value(end)
    minutes = F.timestamp_diff("MINUTE", s, e)
    codes = [F.when(s.isNull() | e.isNull(), "BAD_TIME_VALUE"), F.when(e <= s, "SEMANTIC_TIME_ORDER")]
    if most_minutes is not None:
        codes.append(F.when(minutes > most_minutes, "SEMANTIC_DURATION"))
    if now is not None:
        codes.append(F.when(s < time_value(now), "SEMANTIC_PAST_START"))
    return F.array_compact(F.array(*codes))
