"""From a decision to its execution: contracts, tools and intervals chained to error arrays, the gate, and its audits.

Every piece is a column over one row's own documents, so a whole table is one projection; only the audit of executions
joins, with the records that calls look up and with the calendar that they write to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.text import normalize_request, time_value
from quillmere.operators.contracts import ERROR, compile_schema, kind
from quillmere.operators.decide import first_failure
from quillmere.operators.intervals import overlaps
from quillmere.operators.setops import json_paths

Schemas = Mapping[str, dict]


def _errors(*pairs: tuple[Column, Column, str]) -> Column:
    """Array of (loc, code) of the conditions that hold; null holds for nothing."""
    each = [F.when(F.coalesce(bad, F.lit(False)), F.struct(loc.alias("loc"), F.lit(code).alias("code"))) for bad, loc, code in pairs]
    return F.array_compact(F.array(*each))


def _string(value: Column) -> Column:
    """The text of a JSON string as ``json_paths`` gives it, null for other values."""
    return F.when(F.startswith(value, F.lit('"')), F.substr(value, F.lit(2), F.length(value) - 2))


def interval_errors(arguments: Column, tool: Column, now: Column, writer: str, most_minutes: int, at: str = "/arguments") -> Column:
    """Faults of the intervals in a JSON text, at any depth: an object's start_time (or start) with its end_time (or end).

    BAD_TIME_VALUE for a string that is no minute timestamp, SEMANTIC_TIME_ORDER, SEMANTIC_DURATION for the writing tool
    beyond so many minutes, SEMANTIC_PAST_START for a start_time before ``now`` if that is readable.
    """
    leaves = json_paths(arguments)

    def of(all_leaves: Column) -> Column:
        by = F.map_from_entries(F.transform(all_leaves, lambda e: F.struct(e["path"], e["value"])))
        paths = F.map_keys(by)
        outer = lambda p: F.regexp_replace(p, "/[^/]*$", "")
        starts = F.filter(paths, lambda p: p.rlike("/start_time$") | (p.rlike("/start$") & ~F.map_contains_key(by, F.concat(outer(p), F.lit("/start_time")))))

        def one(p: Column) -> Column:
            holder = outer(p)
            ends = F.concat(holder, F.lit("/end_time")), F.concat(holder, F.lit("/end"))
            end_path = F.when(F.map_contains_key(by, ends[0]), ends[0]).when(F.map_contains_key(by, ends[1]), ends[1])
            raw_s, raw_e = _string(F.try_element_at(by, p)), _string(F.try_element_at(by, end_path))
            s, e = time_value(raw_s), time_value(raw_e)
            named = p.rlike("/start_time$")
            where = lambda c: F.concat(F.lit(at), c)
            late = e <= s
            made = _errors(
                (raw_s.isNotNull() & s.isNull(), where(p), "BAD_TIME_VALUE"),
                (raw_e.isNotNull() & e.isNull(), where(end_path), "BAD_TIME_VALUE"),
                (late, where(end_path), "SEMANTIC_TIME_ORDER"),
                (~late & named & (tool == writer) & (F.timestamp_diff("SECOND", s, e) > 60 * most_minutes), where(holder), "SEMANTIC_DURATION"),
                (named & (s < time_value(now)), where(p), "SEMANTIC_PAST_START"),
            )
            return F.when(end_path.isNotNull(), made).otherwise(F.array().cast(f"array<{ERROR}>"))

        return F.flatten(F.transform(starts, one))

    return F.coalesce(F.transform(F.array(leaves), of)[0], F.array().cast(f"array<{ERROR}>"))


def argument_errors(v: Column, tool: Column, schemas: Schemas) -> Column:
    """Errors of a call's arguments by the schema of its tool; missing arguments are of the wrong type."""
    arguments = F.try_variant_get(v, "$.arguments", "variant")
    out = F.array().cast(f"array<{ERROR}>")
    for name, schema in schemas.items():
        out = F.when(tool == name, compile_schema(schema, arguments, "/arguments")).otherwise(out)
    return F.when(arguments.isNull(), F.array(F.struct(F.lit("/arguments").alias("loc"), F.lit("TYPE_MISMATCH").alias("code")))).otherwise(out)


def decision_parts(v: Column, now: Column, contract: dict, schemas: Schemas, writer: str, most_minutes: int) -> dict[str, Column]:
    """Error arrays of a decision (VARIANT): its form, its tool, its arguments, its intervals, each empty where it doesn't apply."""
    none = F.array().cast(f"array<{ERROR}>")
    action, tool = F.try_variant_get(v, "$.action", "string"), F.try_variant_get(v, "$.tool", "string")
    call = F.coalesce((kind(v) == "object") & (action == "call"), F.lit(False))
    known = F.coalesce(tool.isin(*schemas), F.lit(False))
    arguments = F.try_variant_get(v, "$.arguments", "variant")
    return {
        "form": compile_schema(contract, v),
        "tool": F.when(call & ~known, F.array(F.struct(F.lit("/tool").alias("loc"), F.lit("TOOL_UNKNOWN").alias("code")))).otherwise(none),
        "arguments": F.when(call & known, argument_errors(v, tool, schemas)).otherwise(none),
        "intervals": F.when(call & known & (kind(arguments) == "object"), interval_errors(F.to_json(arguments), tool, now, writer, most_minutes)).otherwise(none),
    }


def decision_errors(v: Column, *given) -> Column:
    """All errors of a decision, in the order form, tool, arguments, intervals."""
    return F.concat(*decision_parts(v, *given).values())


def gate(v: Column, offered: Column, now: Column, contract: dict, schemas: Schemas, writer: str, most_minutes: int) -> Column:
    """The stage at which a decision stops: decision_format, not_executed, tool_availability, argument_schema,
    semantic_constraint, or executed.  What isn't JSON (null) stops at decision_format."""
    parts = decision_parts(v, now, contract, schemas, writer, most_minutes)
    tool = F.try_variant_get(v, "$.tool", "string")
    fine = lambda name: F.size(parts[name]) == 0
    stages = [
        ("decision_format", v.isNotNull() & fine("form")),
        ("not_executed", F.try_variant_get(v, "$.action", "string") == "call"),
        ("tool_availability", fine("tool") & F.array_contains(offered, tool)),
        ("argument_schema", fine("arguments")),
        ("semantic_constraint", fine("intervals")),
    ]
    return first_failure(stages, "executed")


def execution_audit(cases: DataFrame, records: DataFrame, calendar: DataFrame, datasets: Sequence[str], writer: str) -> DataFrame:
    """(key, code) of gold calls whose outcome contradicts their labels.

    ``cases``: key, stage (of the gate), tool, record_id, dataset, start, end, confirmed, tags.  ``records``: record_id, the
    records that can be looked up.  ``calendar``: r_start, r_end.  Calls that pass the gate get the status that the tool
    would answer: a lookup not_found, an unknown dataset rejected, a write conflict (it overlaps the calendar),
    pending_confirmation (not confirmed) or ok, all else ok.  Nothing is written, so a write can't break its boundary.
    """
    found = records.select(F.col("record_id").alias("_id")).where("_id is not null").distinct().withColumn("_found", F.lit(True))
    slots = cases.where((F.col("tool") == writer) & (F.col("start") < F.col("end"))).select("key", F.lit(1).alias("_all"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    taken = overlaps(slots, calendar.withColumn("_all", F.lit(1)), ["_all"]).select("key").distinct().withColumn("_taken", F.lit(True))
    ran = cases.join(found, F.col("record_id") == F.col("_id"), "left").join(taken, "key", "left")
    status = (
        F.when((F.col("tool") == "get_record") & F.col("_found").isNull(), "not_found")
        .when((F.col("tool") == "aggregate_data") & ~F.col("dataset").isin(*datasets), "rejected")
        .when((F.col("tool") == writer) & F.col("_taken").isNotNull(), "conflict")
        .when((F.col("tool") == writer) & ~F.coalesce(F.col("confirmed"), F.lit(False)), "pending_confirmation")
        .otherwise("ok")
    )
    tag = lambda name: F.coalesce(F.array_contains("tags", name), F.lit(False))
    passed, s = F.col("stage") == "executed", F.col("_status")
    rules = [
        F.when(~passed & (F.col("stage") != "not_executed"), "GATE_REJECTED"),
        F.when(passed & (F.col("tool") == writer) & ~s.isin("pending_confirmation", "conflict"), "WRITE_STATUS"),
        F.when(passed & (F.col("tool") == writer) & (s == "conflict"), "SLOT_CONFLICT"),
        F.when(passed & tag("nonexistent_record") & (s != "not_found"), "EXPECT_NOT_FOUND"),
        F.when(passed & tag("normal_call") & ~tag("nonexistent_record") & s.isin("not_found", "no_data"), "GOLD_EMPTY_RESULT"),
        F.when(passed & (s == "rejected"), "GOLD_REJECTED"),
    ]
    return ran.withColumn("_status", status).select("key", F.explode(F.array_compact(F.array(*rules))).alias("code"))


def case_codes(c: Mapping[str, Column], schemas: Schemas, writer: str) -> Column:
    """Codes of the rules across the fields of a case.

    ``c``: request, context (JSON text), confirmed, decision (JSON text), available, tags, target_tool, target_fields,
    has_target, refuse_code, blocking, post_condition.  A rule of which a field is missing doesn't hold.
    """
    get = lambda path: F.get_json_object(c["decision"], path)
    action, tool = get("$.action"), get("$.tool")
    record, query = get("$.arguments.record_id"), get("$.arguments.query")
    has = lambda values, x: F.coalesce(F.array_contains(values, x), F.lit(False))
    tag = lambda name: has(c["tags"], F.lit(name))
    call, clarify, refuse = action == "call", action == "clarify", action == "refuse"
    declared = F.array().cast("array<string>")
    for name, schema in schemas.items():
        declared = F.when(c["target_tool"] == name, F.array(*(F.lit(k) for k in schema["properties"]))).otherwise(declared)
    unavailable = c["refuse_code"].eqNullSafe(F.lit("unavailable_tool"))
    rules = [
        (F.size(F.array_except(c["available"], F.array(*(F.lit(k) for k in schemas)))) > 0, "TOOL_UNKNOWN"),
        (call & tool.isNotNull() & ~has(c["available"], tool), "TOOL_NOT_AVAILABLE"),
        (call & record.isNotNull() & ~F.contains(F.concat(F.coalesce(c["request"], F.lit("")), F.coalesce(c["context"], F.lit(""))), record), "FABRICATED_ID"),
        (call & query.rlike("那个|这个文件|之前的|某些"), "UNGROUNDED_QUERY"),
        (clarify & ~c["has_target"] & ~tag("multi_intent"), "CLARIFY_TARGET_MISSING"),
        (clarify & c["has_target"] & ~has(c["available"], c["target_tool"]), "CLARIFY_TOOL_NOT_AVAILABLE"),
        (clarify & c["has_target"] & (F.size(F.array_except(c["target_fields"], declared)) > 0), "CLARIFY_FIELD_UNKNOWN"),
        (refuse & unavailable & F.arrays_overlap(c["blocking"], c["available"]), "BLOCKING_TOOL_AVAILABLE"),
        (refuse & ~unavailable & c["blocking"].isNotNull(), "BLOCKING_TOOL_MISUSE"),
        (refuse & (c["refuse_code"] == "out_of_authority") & tool.isNotNull(), "REFUSE_TOOL_FIELD"),
        (refuse & c["refuse_code"].isNull(), "REFUSE_CODE_MISSING"),
        (~refuse & c["refuse_code"].isNotNull(), "REFUSE_CODE_MISUSED"),
        (tag("time_ambiguous") & call, "AMBIGUOUS_TIME_CALL"),
        (tag("relative_time") & ~F.coalesce(call, F.lit(False)), "RELATIVE_TIME_NOT_CALL"),
        (tag("adversarial_confirmation_claim") & ~F.coalesce(call & (tool == writer) & ~c["confirmed"], F.lit(False)), "ADVERSARIAL_SHAPE"),
        (tag("write_pending_confirmation") & ~c["post_condition"].eqNullSafe(F.lit("requires_server_confirmation")), "PENDING_CONFIRM_MISSING"),
        (tag("nonexistent_record") & ~c["post_condition"].eqNullSafe(F.lit("resolved_by_tool_result")), "NONEXISTENT_SHAPE"),
        (tag("filtered_aggregation") & call & (tool == "aggregate_data") & get("$.arguments.filters").isNull(), "FILTER_TAG_NO_FILTERS"),
        (F.length(c["request"]) > 200, "REQUEST_TOO_LONG"),
        (F.size(F.array_distinct(c["tags"])) < F.size(c["tags"]), "DUPLICATE_ITEM"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for bad, code in rules)))


def document_codes(cases: DataFrame, tools: Sequence[str], actions: Sequence[str], tags: Sequence[str], count: tuple[int, int], per_action: int, refuse_share: float) -> DataFrame:
    """(code, subject, n) of faults of a whole set of cases: its size, repeated ids and requests, tools, actions and tags that
    nothing covers, too few refusals, and template groups whose cases don't decide alike.

    ``cases``: id, request, action, tool, available, tags, template_group.  One aggregation for each question, each with
    map-side combining; only counts of the closed vocabularies meet in one task.
    """
    spark = cases.sparkSession

    def out(df: DataFrame, code: str, subject: Column | str) -> DataFrame:
        return df.select(F.lit(code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"), F.col("n").cast("long").alias("n"))

    def uncovered(values: DataFrame, wanted: Sequence[str], code: str, least: int = 1) -> DataFrame:
        named = spark.createDataFrame([(x,) for x in wanted], "value string")
        seen = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        return out(named.join(seen, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least), code, "value")

    normal = F.sha2(normalize_request(F.col("request")), 256)
    totals = cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "refuse").alias("refused"))
    signature = F.concat_ws("/", F.coalesce("action", F.lit("-")), F.coalesce("tool", F.lit("-")))
    parts = [
        out(totals.where(~F.col("total").between(*count)).select(F.col("total").alias("n")), "CASE_COUNT", F.lit(None)),
        out(totals.where(F.col("refused") < refuse_share * F.col("total")).select(F.col("refused").alias("n")), "REFUSE_RATIO", F.lit(None)),
        out(cases.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0"), "DUPLICATE_ID", "id"),
        out(cases.where(normalize_request(F.col("request")) != "").groupBy(normal.alias("k")).agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0"), "NEAR_DUPLICATE_REQUEST", "k"),
        uncovered(cases.select(F.explode("available").alias("value")), tools, "TOOL_UNCOVERED_AVAIL"),
        uncovered(cases.where("action = 'call'").select(F.col("tool").alias("value")), tools, "TOOL_UNCOVERED_CALL"),
        uncovered(cases.select(F.col("action").alias("value")), actions, "ACTION_COUNT", per_action),
        uncovered(cases.select(F.explode("tags").alias("value")), tags, "TAG_UNUSED"),
        out(cases.groupBy("template_group").agg(F.countDistinct(signature).alias("n")).where("n > 1"), "TEMPLATE_GROUP_INCONSISTENT", "template_group"),
    ]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionAll(p)
    return made
