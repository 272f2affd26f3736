"""Queries of the set operators and implicit joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators.setops import json_differences, json_paths, key_differences, repeated, same_members, unseen
from quillmere.operators.tools import contains_pairs
from quillmere.session import table

#: Fixed value: which route a tool leads to.
TOOL_ROUTES = {"consult_technical_expert": "technical", "search_realtime_information": "realtime", "query_service_station_and_navigate": "service", "manage_support_ticket": "ticket", "handle_general_conversation": "general"}


def j1_id_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Case ids that only results or only cases and probes have."""
    results = table(spark, sf, "route_rows").where("case_id is not null").select(F.col("case_id").alias("id"))
    cases = table(spark, sf, "agent_route_pairwise_v5").select("id").unionAll(table(spark, sf, "frozen_probes").select("id")).where("id is not null")
    return key_differences(results, cases, ["id"])


def j2_resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Cases that version v3 hasn't answered yet."""
    done = table(spark, sf, "route_rows").where("adapter_version = 'v3'").select(F.col("case_id").alias("id"))
    return unseen(table(spark, sf, "agent_route_pairwise_v5"), done, ["id"]).select("row_id", "id")


def j3_dimension_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Tools of decisions with their route, by a small map."""
    routes = F.create_map(*(F.lit(x) for kv in TOOL_ROUTES.items() for x in kv))
    tool = F.get_json_object("expected_decision", "$.tool")
    return table(spark, sf, "handwritten_v0").select(tool.alias("tool"), F.coalesce(routes[tool], F.lit("none")).alias("route")).groupBy("tool", "route").agg(F.count(F.lit(1)).alias("n"))


def j8_positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Phrasings and questions of a group side by side, as far as the shorter list goes."""
    pairs = F.posexplode(F.slice(F.arrays_zip("phrasings", "questions"), F.lit(1), F.least(F.size("phrasings"), F.size("questions"))))
    return table(spark, sf, "groups_clarify").select("row_id", pairs.alias("place", "z")).select("row_id", "place", F.col("z.phrasings").alias("phrasing"), F.col("z.questions").alias("question"))


def j9_forbidden_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that offer a tool which writes or one that their own clarify target names."""
    rows = table(spark, sf, "handwritten_v0")
    hit = F.arrays_overlap("available_tools", F.array(F.lit("create_event"), F.col("clarify_target.tool")))
    return rows.where(hit & F.col("clarify_target").isNotNull()).groupBy("clarify_target.tool").agg(F.count(F.lit(1)).alias("n"))


def j10_contains_join(spark: SparkSession, sf: str) -> DataFrame:
    """Probes whose id or query stands inside a request, document or case: none should."""
    probes = table(spark, sf, "frozen_probes").select(F.col("id").alias("probe"), F.explode(F.array("id", "query")).alias("needle"))  # 40 rows at every scale
    texts = table(spark, sf, "agent_route_pairwise_v5").select(F.lit("case").alias("kind"), F.col("query").alias("text")).unionAll(table(spark, sf, "documents").select(F.lit("document").alias("kind"), "text"))
    hits = contains_pairs(texts, "text", probes, "needle").groupBy("probe", "kind").agg(F.count(F.lit(1)).alias("n"))
    return probes.select("probe").distinct().join(hits, "probe", "left").select("probe", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))


def x1_union_all(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, route cases and probes under one schema, missing columns null."""
    a = table(spark, sf, "handwritten_v0").select(F.lit("requests").alias("part"), F.col("id"), F.col("user_request").alias("text"), "split")
    b = table(spark, sf, "agent_route_pairwise_v5").select(F.lit("routes").alias("part"), "id", F.col("query").alias("text"))
    c = table(spark, sf, "frozen_probes").select(F.lit("probes").alias("part"), "id", F.col("query").alias("text"))
    all_rows = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return all_rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.count("split").alias("splits"))


def x2_except(spark: SparkSession, sf: str) -> DataFrame:
    """Categories that only requests or only route cases have."""
    a = table(spark, sf, "handwritten_v0").select("category").distinct()
    b = table(spark, sf, "agent_route_pairwise_v5").select("category").distinct()
    return a.exceptAll(b).select("category", F.lit("requests").alias("only_in")).unionAll(b.exceptAll(a).select("category", F.lit("routes").alias("only_in")))


def x3_intersect(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that stand in train and in test as the same string."""
    rows = table(spark, sf, "handwritten_v0").where("user_request is not null")
    return rows.where("split = 'train'").select("user_request").intersect(rows.where("split = 'test'").select("user_request"))


def x4_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "route_rows")
    return rows.groupBy(same_members(F.col("routes"), F.col("calls")).alias("same"), "correct").agg(F.count(F.lit(1)).alias("n"))


def x5_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    return repeated(table(spark, sf, "agent_route_pairwise_v5"), ["id"])


def x6_decision_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of decisions at any depth: how often each path occurs and how many values it has."""
    leaves = table(spark, sf, "handwritten_v0").select(F.explode(json_paths(F.col("expected_decision"))).alias("leaf"))
    return leaves.groupBy(F.regexp_replace("leaf.path", "^/", "").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("leaf.value").alias("values"))


def x6_group_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Where the decision of a request differs from that of the first request of its template group, path by path."""
    rows = table(spark, sf, "handwritten_v0").where("template_group is not null").select("template_group", "row_id", "expected_decision")
    first = rows.groupBy("template_group").agg(F.min("row_id").alias("first_row"), F.min_by(F.struct("expected_decision"), "row_id").alias("first"))
    later = rows.join(first, "template_group").where("row_id > first_row")
    before = later.select("row_id", F.col("first.expected_decision").alias("expected_decision"))
    return json_differences(before, later.select("row_id", "expected_decision"), ["row_id"], "expected_decision")


_ROUTES = " ".join(f"when '{k}' then '{v}'" for k, v in TOOL_ROUTES.items())
_D = "(select case when json_valid(expected_decision) then expected_decision end as d from handwritten_v0)"
_LEAVES = "(select row_id, '/' || k as path, cast(json_extract(d, '$.' || k) as varchar) as v from (select row_id, d, unnest(json_keys(d)) as k from j) where k <> 'arguments' or json_type(d, '$.arguments') <> 'OBJECT' union all select row_id, '/arguments/' || k, cast(json_extract(d, '$.arguments.' || k) as varchar) from (select row_id, d, unnest(json_keys(d, '$.arguments')) as k from j where json_type(d, '$.arguments') = 'OBJECT'))"
SQL = {
    "x6_group_differences": f"with j as (select row_id, case when json_valid(expected_decision) then expected_decision end as d from handwritten_v0), l as {_LEAVES}, f as (select template_group, min(row_id) as r from handwritten_v0 where template_group is not null group by 1), m as (select h.row_id, f.r from handwritten_v0 h join f on h.template_group = f.template_group where h.row_id > f.r), a as (select m.row_id, path, v from m join l on l.row_id = m.r), b as (select m.row_id, path, v from m join l on l.row_id = m.row_id) select coalesce(a.row_id, b.row_id) as row_id, coalesce(a.path, b.path) as path, a.v as left, b.v as right from a full outer join b on a.row_id = b.row_id and a.path = b.path where a.v is distinct from b.v",
    # decisions have no object below their arguments, which is never empty
    "x6_decision_paths": f"select path, count(*) as n, count(distinct v) as values from (select k as path, cast(json_extract(d, '$.' || k) as varchar) as v from (select d, unnest(json_keys(d)) as k from {_D}) where k <> 'arguments' or json_type(d, '$.arguments') <> 'OBJECT' union all select 'arguments/' || k, cast(json_extract(d, '$.arguments.' || k) as varchar) from (select d, unnest(json_keys(d, '$.arguments')) as k from {_D} where json_type(d, '$.arguments') = 'OBJECT')) group by 1",
    "j1_id_set_equality": "with r as (select distinct case_id as id from route_rows where case_id is not null), c as (select distinct id from (select id from agent_route_pairwise_v5 union all select id from frozen_probes) where id is not null) select coalesce(r.id, c.id) as id, case when c.id is null then 'left' else 'right' end as only_in from r full outer join c on r.id = c.id where r.id is null or c.id is null",
    "j2_resume_anti": "select row_id, id from agent_route_pairwise_v5 a where not exists (select 1 from route_rows r where r.adapter_version = 'v3' and r.case_id is not distinct from a.id)",
    "j3_dimension_lookup": f"select tool, case tool {_ROUTES} else 'none' end as route, count(*) as n from (select case when json_valid(expected_decision) then json_extract_string(expected_decision, '$.tool') end as tool from handwritten_v0) group by 1, 2",
    "j8_positional_zip": "select row_id, cast(i - 1 as int) as place, phrasings[i] as phrasing, questions[i] as question from (select row_id, phrasings, questions, unnest(range(1, least(len(phrasings), len(questions)) + 1)) as i from groups_clarify)",
    "j9_forbidden_tools": "select clarify_target.tool as tool, count(*) as n from handwritten_v0 where clarify_target is not null and list_has_any(available_tools, ['create_event', clarify_target.tool]) group by 1",
    "j10_contains_join": "with p as (select id as probe, unnest([id, query]) as needle from frozen_probes), t as (select 'case' as kind, query as text from agent_route_pairwise_v5 union all select 'document', text from documents), h as (select probe, kind, count(*) as n from t join p on contains(text, needle) group by 1, 2) select d.probe, coalesce(kind, 'none') as kind, coalesce(n, 0) as n from (select distinct probe from p) d left join h on d.probe = h.probe",
    "x1_union_all": "select 'requests' as part, count(*) as n, count(user_request) as texts, count(split) as splits from handwritten_v0 union all select 'routes', count(*), count(query), 0 from agent_route_pairwise_v5 union all select 'probes', count(*), count(query), 0 from frozen_probes",
    "x2_except": "select category, 'requests' as only_in from (select category from handwritten_v0 except select category from agent_route_pairwise_v5) union all select category, 'routes' from (select category from agent_route_pairwise_v5 except select category from handwritten_v0)",
    "x3_intersect": "select user_request from handwritten_v0 where split = 'train' and user_request is not null intersect select user_request from handwritten_v0 where split = 'test'",
    "x4_set_equality": "select list_sort(routes) = list_sort(calls) as same, correct, count(*) as n from route_rows group by 1, 2",
    "x5_repeated_ids": "select id, count(*) as n from agent_route_pairwise_v5 group by 1 having count(*) > 1",
}
QUERIES = {f.__name__: f for f in (j1_id_set_equality, j2_resume_anti, j3_dimension_lookup, j8_positional_zip, j9_forbidden_tools, j10_contains_join, x1_union_all, x2_except, x3_intersect, x4_set_equality, x5_repeated_ids, x6_decision_paths, x6_group_differences)}
