"""Queries of the grouped metrics over route results, route cases, requests and template groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.operators.metrics import ranked_percentiles, rate, summary_sets, thousandths_mean
from quillmere.session import table


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Route results with the category and expected routes of their case; a case delivered twice counts as its first row."""
    cases = table(spark, sf, "agent_route_pairwise_v5").groupBy("id").agg(F.min_by(F.struct("category", "expected_routes"), "row_id").alias("c"))
    rows = table(spark, sf, "route_rows")
    return rows.join(cases, rows["case_id"] == cases["id"], "left").select("row_id", "case_id", "adapter_version", "routes", "reason", "error", "latency_ms", "correct", "run_day", F.col("c.category").alias("category"), F.col("c.expected_routes").alias("expected_routes"))


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        rate(F.count_if(F.col("error").isNull()), F.count(F.lit(1))).alias("format_valid_rate"),
        rate(F.count_if(F.col("error").isNull() & F.col("correct")), F.count_if(F.col("error").isNull())).alias("correct_rate"),
        F.count_if(F.col("reason") == "model").alias("by_model"),
        thousandths_mean(F.when(F.col("latency_ms").between(0, 100000), F.col("latency_ms"))).alias("mean_latency_us"),
    ]


def a1_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary_sets(_results(spark, sf), [["adapter_version"], ["adapter_version", "category"]], _measures())


def a2_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return summary_sets(_results(spark, sf), [[], ["category"]], [F.count(F.lit(1)).alias("n"), rate(F.count_if("correct"), F.count(F.lit(1))).alias("correct_rate"), F.max(F.size("routes")).alias("most_routes")])


def a3_paired(spark: SparkSession, sf: str) -> DataFrame:
    """Cases answered by two versions: right in one, the other, both; a version's answer is its latest row."""
    latest = table(spark, sf, "route_rows").where("adapter_version in ('v2', 'v3') and case_id is not null").groupBy("case_id", "adapter_version").agg(F.max_by("correct", "row_id").alias("ok"))
    a = latest.where("adapter_version = 'v2'").select("case_id", F.col("ok").alias("ok_a"))
    b = latest.where("adapter_version = 'v3'").select("case_id", F.col("ok").alias("ok_b"))
    return a.join(b, "case_id").agg(F.count(F.lit(1)).alias("cases"), F.count_if("ok_a").alias("right_a"), F.count_if("ok_b").alias("right_b"), F.count_if(F.col("ok_a") & F.col("ok_b")).alias("both"), F.count_if(F.col("ok_a") != F.col("ok_b")).alias("changed"))


def a4_confusion(spark: SparkSession, sf: str) -> DataFrame:
    made = _results(spark, sf).where("expected_routes is not null").select(F.array_join(F.array_sort("expected_routes"), "+").alias("expected"), F.coalesce(F.array_join(F.array_sort("routes"), "+"), F.lit("none")).alias("actual"))
    return made.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))


def a5_latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of all latencies of each version and day, with linear interpolation, unrounded."""
    made = ranked_percentiles(table(spark, sf, "route_rows"), ["adapter_version", "run_day"], "latency_ms", "row_id", [0.5, 0.95])
    return made.select("adapter_version", "run_day", "n", F.col("at")[0].alias("p50"), F.col("at")[1].alias("p95"))


def a5_latency_means(spark: SparkSession, sf: str) -> DataFrame:
    """Of each version and whether it was right: rows, rows with a latency, and the mean in thousandths of a millisecond, rounded half up."""
    return table(spark, sf, "route_rows").groupBy("adapter_version", "correct").agg(F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("timed"), thousandths_mean(F.col("latency_ms")).alias("mean_us"))


def a6_tag_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "handwritten_v0").select("split", F.explode("tags").alias("tag")).groupBy("split", "tag").agg(F.count(F.lit(1)).alias("n"))


def a6_split_distribution(spark: SparkSession, sf: str) -> DataFrame:
    action = F.get_json_object("expected_decision", "$.action")
    return table(spark, sf, "handwritten_v0").groupBy("split").agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("template_group").alias("groups"), F.countDistinct("category").alias("categories"), rate(F.count_if(action == "refuse"), F.count(F.lit(1))).alias("refuse_ratio"))


def a7_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf, "documents").groupBy("lang").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.floor(F.sum(n) / F.count(n)).alias("floor_mean"))


def a8_over_budget(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf, "documents").groupBy("source").agg(F.count(n).alias("texts"), F.bround(F.sum(n) / F.count(n), 1).alias("mean_chars"), F.count_if(n > 1280).alias("over"))


def a9_top_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The six most frequent reasons, ties by name."""
    return table(spark, sf, "route_rows").where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(6)


def a10_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    key: Column = F.concat_ws(":", F.coalesce("reason", F.lit("none")), F.coalesce(F.col("correct").cast("string"), F.lit("unknown")))
    return table(spark, sf, "route_rows").groupBy(key.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def a11_registry_coverage(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "groups_clarify")
    return groups.groupBy("category").agg(F.sum(F.size("phrasings")).alias("phrasings"), F.sum(F.size("questions")).alias("questions"), F.sum(F.aggregate("phrasings", F.lit(0), lambda acc, p: acc + F.length(p))).alias("chars"))


def a12_group_phrasings(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "groups_clarify").select("id", F.explode("phrasings").alias("p")).groupBy("id").agg(F.count(F.lit(1)).alias("phrasings"), F.countDistinct("p").alias("different"))
    return made.where("phrasings <> different or phrasings = 1")


def a13_best_day(spark: SparkSession, sf: str) -> DataFrame:
    """Of each version the day with the lowest greatest latency, ties by day."""
    days = table(spark, sf, "route_rows").where("latency_ms > 0").groupBy("adapter_version", "run_day").agg(F.max("latency_ms").alias("worst"))
    return days.groupBy("adapter_version").agg(F.min(F.struct("worst", "run_day")).alias("b")).select("adapter_version", F.col("b.run_day").alias("best_day"), F.col("b.worst").alias("worst_ms"))


def a14_delta(spark: SparkSession, sf: str) -> DataFrame:
    made = _results(spark, sf).where("adapter_version in ('v1', 'v2')").groupBy("category").agg(*(rate(F.count_if((F.col("adapter_version") == v) & F.col("correct")), F.count_if(F.col("adapter_version") == v)).alias(v) for v in ("v1", "v2")))
    return made.select("category", F.col("v1").alias("before_rate"), F.col("v2").alias("after_rate"), F.bround(F.col("v2") - F.col("v1"), 4).alias("delta"))


def a15_check_tally(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "route_rows")
    checks = {"has_case": F.col("case_id").isNotNull(), "has_version": F.col("adapter_version").isNotNull(), "latency_positive": F.coalesce(F.col("latency_ms") > 0, F.lit(False)), "one_route": F.coalesce(F.size("routes") == 1, F.lit(False))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("section"), v.alias("passed")) for k, v in checks.items()))).alias("c")
    return rows.select(each).rollup(F.col("c.section").alias("section")).agg(F.count(F.lit(1)).alias("total"), F.count_if("c.passed").alias("passed"), F.count_if(~F.col("c.passed")).alias("failed"))


def a16_longest_so_far(spark: SparkSession, sf: str) -> DataFrame:
    """Latest running maximum per version and day: the greatest latency up to and including that day."""
    days = table(spark, sf, "route_rows").where("latency_ms is not null").groupBy("adapter_version", "run_day").agg(F.max("latency_ms").alias("day_max"))
    return days.select("adapter_version", "run_day", "day_max", F.max("day_max").over(W.partitionBy("adapter_version").orderBy("run_day")).alias("max_so_far"))


def a17_first_per_category(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "handwritten_v0").groupBy("category").agg(F.min("row_id").alias("first_row"), F.min_by("id", "row_id").alias("first_id"))


def a18_actions_per_split(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "handwritten_v0").groupBy("split").agg(F.array_join(F.array_sort(F.collect_set(F.get_json_object("expected_decision", "$.action"))), ",").alias("actions"), F.count(F.lit(1)).alias("n"))
    return made


_RESULTS = "(select r.*, c.category, c.expected_routes from route_rows r left join (select id, category, expected_routes from (select *, row_number() over (partition by id order by row_id) as rn from agent_route_pairwise_v5) where rn = 1) c on r.case_id = c.id)"
_L = "case when latency_ms between 0 and 100000 then latency_ms end"
_US = f"(2 * sum(cast(round({_L} * 1000) as bigint)) + count({_L})) // (2 * count({_L}))"
_M = f"count(*) as n, round_even(count(*) filter (error is null) / count(*), 4) as format_valid_rate, round_even(count(*) filter (error is null and correct) / nullif(count(*) filter (error is null), 0), 4) as correct_rate, count(*) filter (reason = 'model') as by_model, case when count({_L}) > 0 then cast({_US} as bigint) end as mean_latency_us"

SQL = {
    "a1_summary": f"select adapter_version, category, cast(grouping(adapter_version, category) as bigint) as level, {_M} from {_RESULTS} group by grouping sets ((adapter_version), (adapter_version, category))",
    "a2_rollup": f"select category, cast(grouping(category) as bigint) as level, count(*) as n, round_even(count(*) filter (correct) / count(*), 4) as correct_rate, cast(max(len(routes)) as int) as most_routes from {_RESULTS} group by grouping sets ((), (category))",
    "a3_paired": "with l as (select case_id, adapter_version, arg_max_null(correct, row_id) as ok from route_rows where adapter_version in ('v2', 'v3') and case_id is not null group by 1, 2) select count(*) as cases, count(*) filter (a.ok) as right_a, count(*) filter (b.ok) as right_b, count(*) filter (a.ok and b.ok) as both, count(*) filter (a.ok <> b.ok) as changed from l a join l b on a.case_id = b.case_id and a.adapter_version = 'v2' and b.adapter_version = 'v3'",
    "a4_confusion": f"select array_to_string(list_sort(expected_routes), '+') as expected, coalesce(array_to_string(list_sort(routes), '+'), 'none') as actual, count(*) as n from {_RESULTS} where expected_routes is not null group by 1, 2",
    "a5_latency_percentiles": "with r as (select adapter_version, run_day, latency_ms as v, row_number() over (partition by adapter_version, run_day order by latency_ms, row_id) - 1 as k, count(*) over (partition by adapter_version, run_day) as n from route_rows where latency_ms is not null), e as (select adapter_version, run_day, n, max(v) filter (k = floor((n - 1) * 0.5::double)) as l50, max(v) filter (k = ceil((n - 1) * 0.5::double)) as h50, max(v) filter (k = floor((n - 1) * 0.95::double)) as l95, max(v) filter (k = ceil((n - 1) * 0.95::double)) as h95 from r group by all) select adapter_version, run_day, n, l50 + (h50 - l50) * ((n - 1) * 0.5::double - floor((n - 1) * 0.5::double)) as p50, l95 + (h95 - l95) * ((n - 1) * 0.95::double - floor((n - 1) * 0.95::double)) as p95 from e",
    "a5_latency_means": "select adapter_version, correct, count(*) as n, count(latency_ms) as timed, case when count(latency_ms) > 0 then cast(floor((2 * sum(cast(round(latency_ms * 1000) as bigint)) + count(latency_ms)) / (2 * count(latency_ms))) as bigint) end as mean_us from route_rows group by 1, 2",
    "a6_tag_distribution": "select split, tag, count(*) as n from (select split, unnest(tags) as tag from handwritten_v0) group by 1, 2",
    "a6_split_distribution": "select split, count(*) as samples, count(distinct template_group) as groups, count(distinct category) as categories, round_even(count(*) filter (json_valid(expected_decision) and json_extract_string(expected_decision, '$.action') = 'refuse') / count(*), 4) as refuse_ratio from handwritten_v0 group by 1",
    "a7_length_stats": "select lang, cast(min(length(text)) as int) as shortest, cast(max(length(text)) as int) as longest, cast(sum(length(text)) // count(text) as bigint) as floor_mean from documents group by 1",
    "a8_over_budget": "select source, count(text) as texts, round_even(sum(length(text)) / count(text), 1) as mean_chars, count(*) filter (length(text) > 1280) as over from documents group by 1",
    "a9_top_reasons": "select reason, count(*) as n from route_rows where reason is not null group by 1 order by n desc, reason limit 6",
    "a10_status_counts": "select coalesce(reason, 'none') || ':' || coalesce(cast(correct as varchar), 'unknown') as status, count(*) as n from route_rows group by 1",
    "a11_registry_coverage": "select category, cast(sum(len(phrasings)) as bigint) as phrasings, cast(sum(len(questions)) as bigint) as questions, cast(sum(list_sum(list_transform(phrasings, lambda p: length(p)))) as bigint) as chars from groups_clarify group by 1",
    "a12_group_phrasings": "select id, count(*) as phrasings, count(distinct p) as different from (select id, unnest(phrasings) as p from groups_clarify) group by 1 having count(*) <> count(distinct p) or count(*) = 1",
    "a13_best_day": "select adapter_version, run_day as best_day, worst as worst_ms from (select *, row_number() over (partition by adapter_version order by worst, run_day) as rn from (select adapter_version, run_day, max(latency_ms) as worst from route_rows where latency_ms > 0 group by 1, 2)) where rn = 1",
    "a14_delta": f"select category, b as before_rate, a as after_rate, round_even(a - b, 4) as delta from (select category, round_even(count(*) filter (adapter_version = 'v1' and correct) / nullif(count(*) filter (adapter_version = 'v1'), 0), 4) as b, round_even(count(*) filter (adapter_version = 'v2' and correct) / nullif(count(*) filter (adapter_version = 'v2'), 0), 4) as a from {_RESULTS} where adapter_version in ('v1', 'v2') group by 1)",
    "a15_check_tally": "select section, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed from (select 'has_case' as section, case_id is not null as passed from route_rows union all select 'has_version', adapter_version is not null from route_rows union all select 'latency_positive', coalesce(latency_ms > 0, false) from route_rows union all select 'one_route', coalesce(len(routes) = 1, false) from route_rows) group by rollup (section)",
    "a16_longest_so_far": "select adapter_version, run_day, day_max, max(day_max) over (partition by adapter_version order by run_day) as max_so_far from (select adapter_version, run_day, max(latency_ms) as day_max from route_rows where latency_ms is not null group by 1, 2)",
    "a17_first_per_category": "select category, row_id as first_row, id as first_id from (select *, row_number() over (partition by category order by row_id) as rn from handwritten_v0) where rn = 1",
    "a18_actions_per_split": "select split, array_to_string(list_sort(list_distinct(list(case when json_valid(expected_decision) then json_extract_string(expected_decision, '$.action') end))), ',') as actions, count(*) as n from handwritten_v0 group by 1",
}
QUERIES = {f.__name__: f for f in (a1_summary, a2_rollup, a3_paired, a4_confusion, a5_latency_percentiles, a5_latency_means, a6_tag_distribution, a6_split_distribution, a7_length_stats, a8_over_budget, a9_top_reasons, a10_status_counts, a11_registry_coverage, a12_group_phrasings, a13_best_day, a14_delta, a15_check_tally, a16_longest_so_far, a17_first_per_category, a18_actions_per_split)}
