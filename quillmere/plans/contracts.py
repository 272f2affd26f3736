"""Queries of row-level contracts: decisions, samples, template groups and tables against declared rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.jsonvalue import strict_json
from quillmere.functions.text import NARROW, WIDE, group_number, plain_name, split_name
from quillmere.operators.contracts import compile_schema
from quillmere.session import table

#: Actions, and tools of decisions.
ACTIONS = ["call", "clarify", "refuse"]
TOOLS = ["search_documents", "get_record", "calculate", "aggregate_data", "check_availability", "create_event"]
DECISION = {
    "type": "object",
    "required": ["action"],
    "properties": {
        "action": {"type": "string", "enum": ACTIONS},
        "tool": {"type": "string", "enum": TOOLS},
        "arguments": {"type": "object", "minProperties": 2},
        "question": {"type": "string", "minLength": 16, "maxLength": 24},
        "reason": {"type": "string", "minLength": 14, "pattern": "。$"},
    },
    "additionalProperties": False,
    "allOf": [
        {"if": {"properties": {"action": {"const": "call"}}, "required": ["action"]}, "then": {"required": ["tool", "arguments"]}},
        {"if": {"properties": {"action": {"const": "clarify"}}, "required": ["action"]}, "then": {"required": ["question"], "not": {"required": ["tool"]}}},
    ],
}
PROPERTIES = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "enum": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]}}, "additionalProperties": False}


def v_decision_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every violation of the decision contract, counted by place and code; what isn't JSON has its own code."""
    rows = table(spark, sf, "handwritten_v0").select(strict_json(F.col("expected_decision")).alias("v"))
    errors = F.when(F.col("v").isNull(), F.array(F.struct(F.lit("/").alias("loc"), F.lit("JSON_SYNTAX").alias("code")))).otherwise(compile_schema(DECISION, F.col("v")))
    return rows.select(F.explode(errors).alias("e")).groupBy("e.loc", "e.code").agg(F.count(F.lit(1)).alias("n"))


def v_event_properties(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", strict_json(F.col("props")).alias("v")).where("v is not null")
    return rows.select("event_id", F.explode(compile_schema(PROPERTIES, F.col("v"))).alias("e")).select("event_id", "e.loc", "e.code")


def v22_table_lint(spark: SparkSession, sf: str) -> DataFrame:
    """Constraints of tables: rows that break each of them."""
    parts = [
        table(spark, sf, "orders").agg(F.lit("orders.status").alias("rule"), F.count_if(~F.coalesce(F.col("o_orderstatus").isin("O", "F", "P"), F.lit(False))).alias("broken")),
        table(spark, sf, "frozen_probes").agg(F.lit("probes.id_pattern").alias("rule"), F.count_if(~F.coalesce(F.col("id").rlike("^PB-[0-9]{4}$"), F.lit(False))).alias("broken")),
        table(spark, sf, "groups_clarify").agg(F.lit("groups.two_phrasings").alias("rule"), F.count_if(F.size("phrasings") < 2).alias("broken")),
        table(spark, sf, "documents").agg(F.lit("documents.n_chars").alias("rule"), F.count_if(F.col("n_chars") != F.length("text")).alias("broken")),
        table(spark, sf, "route_rows").agg(F.lit("results.latency").alias("rule"), F.count_if(~F.coalesce(F.col("latency_ms") >= F.col("model_latency_ms"), F.lit(False))).alias("broken")),
        table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.lit("lineitem.order").alias("rule"), F.count(F.lit(1)).alias("broken")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def v25_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Cases against their template group, ways of writing unified: repeated id, unknown group, other category, other split, missing seed, source or group."""
    g = table(spark, sf, "groups_clarify").select(group_number(F.col("id")).alias("g_id"), plain_name(F.col("category")).alias("g_category"), split_name(F.col("split")).alias("g_split"))
    groups = g.where("g_id is not null").groupBy("g_id").agg(F.min("g_category").alias("g_category"), F.min("g_split").alias("g_split"))
    cases = table(spark, sf, "handwritten_v0").withColumn("_group", group_number(F.col("template_group")))
    # a repeated id is known by its first row, so ids are aggregated and not sorted in a window
    first = cases.groupBy("id").agg(F.min("row_id").alias("_first")).withColumnRenamed("id", "_id")
    c = cases.join(groups, F.col("_group") == F.col("g_id"), "left").join(first, F.col("id").eqNullSafe(F.col("_id")), "left")
    rules = [
        F.when(F.col("row_id") > F.col("_first"), "DUPLICATE_ID"),
        F.when(F.col("_group").isNotNull() & F.col("g_id").isNull(), "GROUP_UNKNOWN"),
        F.when(plain_name(F.col("category")) != F.col("g_category"), "CATEGORY_DRIFT"),
        F.when(split_name(F.col("split")) != F.col("g_split"), "GROUP_SPLIT_DRIFT"),
        F.when(F.col("split").isNotNull() & split_name(F.col("split")).isNull(), "SPLIT_UNKNOWN"),
        F.when(F.col("seed").isNull() | F.col("source").isNull() | F.col("_group").isNull(), "PROVENANCE_MISSING"),
    ]
    return c.select("row_id", F.explode(F.array_compact(F.array(*rules))).alias("code"))


def v28_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Splits, however written, against the wanted shares of rows."""
    bounds = spark.createDataFrame([("train", 0.5, 0.7), ("val", 0.1, 0.11), ("test", 0.1, 0.2), ("unseen_test", 0.2, 0.3)], "split string, low double, high double")
    rows = table(spark, sf, "handwritten_v0").select(split_name(F.col("split")).alias("split"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shares = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return bounds.join(shares, "split", "left").crossJoin(total).select("split", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).between(F.col("low"), F.col("high")).alias("within"))


def plain_sql(c: str) -> str:
    spaced = f"regexp_replace({narrow_sql(c)}, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')"
    return f"regexp_replace(lower(trim({spaced})), '[ _\\-\\x{{2010}}\\x{{2011}}]+', '_', 'g')"


def narrow_sql(c: str) -> str:
    return f"translate({c}, '{WIDE}', '{NARROW.replace(chr(39), chr(39) * 2)}')"


def split_sql(c: str) -> str:
    return f"case when {plain_sql(c)} in ('valid', 'validation', 'dev') then 'val' when {plain_sql(c)} in ('train', 'val', 'test', 'unseen_test') then {plain_sql(c)} end"


def group_sql(c: str) -> str:
    return f"nullif(regexp_extract({narrow_sql(c)}, '0*([0-9]+)[^0-9]*$', 1), '')"


_D = "(select case when json_valid(expected_decision) then expected_decision end as d from handwritten_v0)"
_ACT = "json_extract_string(d, '$.action')"
_HAS = "list_contains(json_keys(d), '{0}')"
_RULES = [
    ("/", "JSON_SYNTAX", "d is null"),
    ("/action", "ENUM_MISMATCH", f"{_ACT} not in ('call', 'clarify', 'refuse')"),
    ("/action", "MISSING_REQUIRED", "not " + _HAS.format("action")),
    ("/tool", "TYPE_MISMATCH", _HAS.format("tool") + " and json_type(d, '$.tool') <> 'VARCHAR'"),
    ("/tool", "ENUM_MISMATCH", f"json_type(d, '$.tool') = 'VARCHAR' and json_extract_string(d, '$.tool') not in ({', '.join(repr(t) for t in TOOLS)})"),
    ("/arguments", "TYPE_MISMATCH", _HAS.format("arguments") + " and json_type(d, '$.arguments') <> 'OBJECT'"),
    ("/arguments", "MIN_PROPERTIES", "json_type(d, '$.arguments') = 'OBJECT' and len(json_keys(d, '$.arguments')) < 2"),
    ("/question", "MIN_LENGTH", "json_type(d, '$.question') = 'VARCHAR' and length(json_extract_string(d, '$.question')) < 16"),
    ("/question", "MAX_LENGTH", "json_type(d, '$.question') = 'VARCHAR' and length(json_extract_string(d, '$.question')) > 24"),
    ("/reason", "MIN_LENGTH", "json_type(d, '$.reason') = 'VARCHAR' and length(json_extract_string(d, '$.reason')) < 14"),
    ("/reason", "PATTERN_MISMATCH", "json_type(d, '$.reason') = 'VARCHAR' and not suffix(json_extract_string(d, '$.reason'), '。')"),
    ("/tool", "MISSING_REQUIRED", f"{_ACT} = 'call' and not " + _HAS.format("tool")),
    ("/arguments", "MISSING_REQUIRED", f"{_ACT} = 'call' and not " + _HAS.format("arguments")),
    ("/question", "MISSING_REQUIRED", f"{_ACT} = 'clarify' and not " + _HAS.format("question")),
    ("/", "FIELD_NOT_ALLOWED", f"{_ACT} = 'clarify' and " + _HAS.format("tool")),
]
def decision_rules() -> list[tuple[str, str, str]]:
    """(place, code, condition) of the decision contract over a column d, null where the decision isn't JSON; extra fields are asked for apart."""
    return list(_RULES)


_EXTRA = f"select '/' || k as loc, 'EXTRA_FIELD' as code, count(*) as n from (select unnest(json_keys(d)) as k from {_D} where d is not null) where k not in ('action', 'tool', 'arguments', 'question', 'reason') group by 1"
SQL = {
    "v_decision_errors": "select loc, code, n from (" + " union all ".join(f"select '{loc}' as loc, '{code}' as code, count(*) filter (coalesce({rule}, false)) as n from {_D}" for loc, code, rule in _RULES) + f") where n > 0 union all {_EXTRA}",
    "v_event_properties": "select event_id, '/k' as loc, case when not list_contains(json_keys(props), 'k') then 'MISSING_REQUIRED' when json_type(props, '$.k') not in ('BIGINT', 'UBIGINT') then 'TYPE_MISMATCH' else 'ENUM_MISMATCH' end as code from events where json_valid(props) and (not list_contains(json_keys(props), 'k') or json_type(props, '$.k') not in ('BIGINT', 'UBIGINT') or cast(json_extract(props, '$.k') as bigint) not between 0 and 9) union all select event_id, '/' || k, 'EXTRA_FIELD' from (select event_id, unnest(json_keys(props)) as k from events where json_valid(props)) where k <> 'k'",
    "v22_table_lint": "select 'orders.status' as rule, count(*) filter (o_orderstatus is null or o_orderstatus not in ('O', 'F', 'P')) as broken from orders union all select 'probes.id_pattern', count(*) filter (not coalesce(regexp_full_match(id, 'PB-[0-9]{4}'), false)) from frozen_probes union all select 'groups.two_phrasings', count(*) filter (len(phrasings) < 2) from groups_clarify union all select 'documents.n_chars', count(*) filter (n_chars <> length(text)) from documents union all select 'results.latency', count(*) filter (not coalesce(latency_ms >= model_latency_ms, false)) from route_rows union all select 'lineitem.order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)",
    "v25_provenance": f"with g as (select g, min(c) as gc, min(s) as gs from (select {group_sql('id')} as g, {plain_sql('category')} as c, {split_sql('split')} as s from groups_clarify) where g is not null group by 1), h as (select row_id, seed, source, split, {group_sql('template_group')} as n, {plain_sql('category')} as c, {split_sql('split')} as s, min(row_id) over (partition by id) as f from handwritten_v0) select row_id, unnest(list_filter([case when row_id > f then 'DUPLICATE_ID' end, case when n is not null and g.g is null then 'GROUP_UNKNOWN' end, case when c <> gc then 'CATEGORY_DRIFT' end, case when s <> gs then 'GROUP_SPLIT_DRIFT' end, case when split is not null and s is null then 'SPLIT_UNKNOWN' end, case when seed is null or source is null or n is null then 'PROVENANCE_MISSING' end], lambda v: v is not null)) as code from h left join g on h.n = g.g",
    "v28_targets": f"select b.split, coalesce(n, 0) as n, coalesce(n, 0) / (select count(*) from handwritten_v0) between low and high as within from (values ('train', 0.5, 0.7), ('val', 0.1, 0.11), ('test', 0.1, 0.2), ('unseen_test', 0.2, 0.3)) b(split, low, high) left join (select {split_sql('split')} as split, count(*) as n from handwritten_v0 group by 1) s on b.split = s.split",
}
QUERIES = {f.__name__: f for f in (v_decision_errors, v_event_properties, v22_table_lint, v25_provenance, v28_targets)}
