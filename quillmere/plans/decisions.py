"""Queries of gates, scores, rule rewriting and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.text import SECOND_TASK, two_tasks
from quillmere.operators.decide import content_fine, covers_all, merged_route, rewrite, route_of, verdict
from quillmere.plans.sets import TOOL_ROUTES
from quillmere.session import table

#: Cue words by missing field.
CUES = {"query": ["检索", "关键词", "查什么"], "record_id": ["编号", "单号"], "record_type": ["类型", "哪类", "检索词"], "start_time": ["时间", "几点", "开始"], "end_time": ["时间", "几点", "结束"], "title": ["标题", "主题"], "dataset": ["数据", "范围", "口径"], "operation": ["统计", "求和", "口径"]}
#: Words of questions about several intents, of reasons by refusal code, and of limits.
TERMS = {
    "multi_intent": ["先", "两步", "还是", "顺序", "分别", "哪一步", "哪个", "逐步"],
    "codes": {
        "unsupported_record_type": ["记录", "类型", "体检报告", "档案"],
        "unsupported_dataset": ["数据集", "人事", "数据范围", "库里"],
        "unsupported_operation": ["统计", "标准差", "分位", "聚合", "均值"],
        "infeasible_time": ["时间", "日期", "过去", "已经", "当前", "空闲"],
        "unavailable_tool": ["工具", "排序", "导出", "Excel"],
        "out_of_authority": ["修改", "改成", "篡改", "调整", "权限", "写入", "越权"],
    },
    "boundary": ["不支持", "只支持", "仅支持", "没有", "无法", "不能", "只能", "不属于", "超出", "不在"],
}
D = "expected_decision"


def score_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Each later delivery of a case scored against its first one, by verdict and category."""
    c = table(spark, sf, "handwritten_v0")
    first = c.groupBy("id").agg(F.min("row_id").alias("row"), F.min_by(D, "row_id").alias("gold"))
    got = c.join(first, "id").where("row_id > row")
    a, g = (lambda p: F.get_json_object(D, p)), (lambda p: F.get_json_object("gold", p))
    v = verdict(a("$.action").isNotNull(), (g("$.action"), a("$.action")), (g("$.tool"), a("$.tool")), g("$.arguments").eqNullSafe(a("$.arguments")), g("$.arguments.query").isNotNull(), g("$.question").eqNullSafe(a("$.question")) & g("$.reason").eqNullSafe(a("$.reason")))
    return got.groupBy("category", v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def score_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Clarifying questions and whether they name every missing field."""
    c = table(spark, sf, "handwritten_v0").where("clarify_target is not null")
    question = F.get_json_object(D, "$.question")
    return c.where(question.isNotNull()).select("row_id", covers_all(question, F.col("clarify_target.fields"), CUES).alias("covered"))


def score_content(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each question and each reason is about its target, by action and refusal code."""
    c = table(spark, sf, "handwritten_v0")
    action = F.get_json_object(D, "$.action")
    said = F.coalesce(F.get_json_object(D, "$.question"), F.get_json_object(D, "$.reason"))
    source = F.concat_ws("|", "user_request", F.to_json("context"))
    fine = content_fine(action, said, source, F.array_contains("tags", "multi_intent"), F.col("clarify_target.fields"), F.col("refuse_code"), TERMS | {"fields": CUES})
    return c.where(action.isin("clarify", "refuse")).groupBy(action.alias("action"), "refuse_code", fine.alias("fine")).agg(F.count(F.lit(1)).alias("n"))


def rule_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that a request meets, of an ordered list."""
    r = F.col("user_request")
    rules = [
        ("bypass_confirmation", r.rlike("不用确认|直接写入|跳过确认")),
        ("two_times", F.regexp_count(r, F.lit("[0-9]{1,2}:[0-9]{2}")) >= 2),
        ("missing_record_id", r.rlike("单子|票据|发货单|合同") & ~r.rlike("(DD|FP|HT|SH)[0-9]{6}")),
        ("aggregate", r.rlike("统计|合计|平均")),
        ("ask_result", r.rlike("[？?]$")),
    ]
    code = rewrite(rules)
    return table(spark, sf, "handwritten_v0").where(r.isNotNull()).select("row_id", F.coalesce(code, F.lit("unchanged")).alias("code"))


def route_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Route results turned into delegations and validated."""
    names = F.create_map(*(F.lit(x) for k, v in TOOL_ROUTES.items() for x in (v, k)))
    cases = table(spark, sf, "agent_route_pairwise_v5").where("query is not null").select("row_id", "query", "expected_routes")
    tool = F.when(F.size("expected_routes") > 0, names[F.element_at("expected_routes", 1)]).otherwise(F.lit("other_tool"))
    made = cases.select("row_id", route_of(F.col("query"), F.when(F.col("row_id") % 11 == 0, "delegate").otherwise("call"), tool, F.col("query"), F.col("row_id") % 7 != 0, TOOL_ROUTES).alias("r"))
    return made.select("row_id", "r.route", "r.reason")


def route_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with two clauses: a route for each clause by its words, and the route they have in common."""
    words = {"technical": "报错|故障|重启|更新到", "realtime": "天气|成绩|几点入场|温度", "service": "维修站|网点|售后|服务站", "ticket": "工单|报修|催"}

    def by_words(c):
        out = F.lit(None).cast("string")
        for route, pattern in reversed(words.items()):
            out = F.when(c.rlike(pattern), F.lit(route)).otherwise(out)
        return out

    parts = two_tasks(F.col("query"))
    made = table(spark, sf, "agent_route_pairwise_v5").where(parts.isNotNull()).select("row_id", F.transform(parts, by_words).alias("routes"))
    return made.select("row_id", F.coalesce(F.col("routes")[0], F.lit("none")).alias("first_route"), F.coalesce(F.col("routes")[1], F.lit("none")).alias("second_route"), merged_route(F.col("routes")).alias("merged"))


def route_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Results against the expected routes: equal as sets and without error, or several routes handed over as multi_task."""
    rows = table(spark, sf, "route_rows")
    cases = table(spark, sf, "agent_route_pairwise_v5").groupBy("id").agg(F.min_by("expected_routes", "row_id").alias("expected"))
    several = F.size("expected") > 1
    right = F.when(several & (F.coalesce(F.size("routes"), F.lit(0)) <= 0), F.col("reason") == "multi_task").otherwise((F.array_sort("routes") == F.array_sort("expected")) & F.col("error").isNull())
    return rows.join(cases, rows["case_id"] == cases["id"]).groupBy("adapter_version", F.coalesce(right, F.lit(False)).alias("right"), "correct").agg(F.count(F.lit(1)).alias("n"))


_J = "case when json_valid({0}) then json_extract_string({0}, '{1}') end"


def _x(path: str, column: str = D) -> str:
    return _J.format(column, path)


_CALLS = " or ".join(f"(list_contains(f, '{k}') and not ({' or '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in ws)}))" for k, ws in CUES.items())
_WORDS = "case when regexp_matches({0}, '报错|故障|重启|更新到') then 'technical' when regexp_matches({0}, '天气|成绩|几点入场|温度') then 'realtime' when regexp_matches({0}, '维修站|网点|售后|服务站') then 'service' when regexp_matches({0}, '工单|报修|催') then 'ticket' end"
_SPLIT = r"string_split_regex(regexp_replace(trim(query), '[。！？!?]+$', ''), '[\t\n\x0B\f\r ]*[，,；;][\t\n\x0B\f\r ]*(?:再|然后|接着|同时|并且|还要|另外)[\t\n\x0B\f\r ]*')"
_SECOND = SECOND_TASK
_FIRST = "(select id, min(row_id) as row, min_by(expected_decision, row_id) as gold from handwritten_v0 group by id)"
_HIT = lambda words: "(" + " or ".join(f"contains(q, '{w}')" for w in words) + ")"
_ABOUT = " or ".join(f"(refuse_code = '{k}' and {_HIT(ws)})" for k, ws in TERMS["codes"].items())
_COVERED = f"not (len(list_filter(f, lambda x: x not in ({', '.join(repr(k) for k in CUES)}))) > 0 or {_CALLS})"
_GROUNDED = "len(list_filter(regexp_extract_all(q, '[0-9]{1,2}:[0-9]{2}'), lambda x: not contains(regexp_replace(concat_ws('|', user_request, cast(to_json(context) as varchar)), '[\\s\\x{3000}\\x{A0}]+', '', 'g'), x))) = 0"
SQL = {
    "score_content": f"select a as action, refuse_code, coalesce(case when a = 'clarify' then {_GROUNDED} and case when coalesce(list_contains(tags, 'multi_intent'), false) then {_HIT(TERMS['multi_intent'])} else {_COVERED} end when a = 'refuse' then {_GROUNDED} and ({_ABOUT}) and {_HIT(TERMS['boundary'])} end, false) as fine, count(*) as n from (select *, {_x('$.action')} as a, coalesce({_x('$.question')}, {_x('$.reason')}) as q, coalesce(clarify_target.fields, []) as f from handwritten_v0) where a in ('clarify', 'refuse') group by 1, 2, 3",
    "score_verdicts": f"select category, case when ga is null then 'invalid' when a is distinct from ga then 'wrong' when a = 'call' and t is distinct from gt then 'wrong' when a = 'call' and r is distinct from gr then 'wrong' when a = 'call' and gq is not null then 'manual_review' when a <> 'call' and not same then 'wrong' else 'correct' end as verdict, count(*) as n from (select category, {_x('$.action')} as a, {_x('$.action', 'gold')} as ga, {_x('$.tool')} as t, {_x('$.tool', 'gold')} as gt, {_x('$.arguments')} as r, {_x('$.arguments', 'gold')} as gr, {_x('$.arguments.query', 'gold')} as gq, ({_x('$.question')}) is not distinct from ({_x('$.question', 'gold')}) and ({_x('$.reason')}) is not distinct from ({_x('$.reason', 'gold')}) as same from handwritten_v0 h join {_FIRST} f on h.id = f.id and h.row_id > f.row) group by 1, 2",
    "score_questions": f"select row_id, not (len(list_filter(f, lambda x: x not in ({', '.join(repr(k) for k in CUES)}))) > 0 or {_CALLS}) as covered from (select row_id, clarify_target.fields as f, {_x('$.question')} as q from handwritten_v0 where clarify_target is not null) where q is not null",
    "rule_rewrites": "select row_id, case when regexp_matches(user_request, '不用确认|直接写入|跳过确认') then 'bypass_confirmation' when len(regexp_extract_all(user_request, '[0-9]{1,2}:[0-9]{2}')) >= 2 then 'two_times' when regexp_matches(user_request, '单子|票据|发货单|合同') and not regexp_matches(user_request, '(DD|FP|HT|SH)[0-9]{6}') then 'missing_record_id' when regexp_matches(user_request, '统计|合计|平均') then 'aggregate' when regexp_matches(user_request, '[？?]$') then 'ask_result' else 'unchanged' end as code from handwritten_v0 where user_request is not null",
    "route_decisions": f"select row_id, case when reason = 'model' then r end as route, reason from (select row_id, r, case when regexp_matches(query, '{_SECOND}') then 'multi_task' when row_id % 11 = 0 then 'non_call' when coalesce(r not in ('technical', 'realtime', 'service', 'ticket', 'general'), true) then 'unknown_tool' when row_id % 7 = 0 then 'invalid_arguments' when trim(query) = '' then 'empty_query' else 'model' end as reason from (select row_id, query, case when len(expected_routes) > 0 then expected_routes[1] end as r from agent_route_pairwise_v5 where query is not null))",
    "route_clauses": f"select row_id, coalesce(a, 'none') as first_route, coalesce(b, 'none') as second_route, case when a = b then a end as merged from (select row_id, {_WORDS.format('p[1]')} as a, {_WORDS.format('p[2]')} as b from (select row_id, {_SPLIT} as p from agent_route_pairwise_v5 where query is not null) where len(p) = 2 and length(p[1]) >= 5 and length(p[2]) >= 5)",
    "route_scores": "select adapter_version, coalesce(case when len(expected) > 1 and coalesce(len(routes), 0) = 0 then reason = 'multi_task' else list_sort(routes) = list_sort(expected) and error is null end, false) as right, correct, count(*) as n from route_rows r join (select id, arg_min_null(expected_routes, row_id) as expected from agent_route_pairwise_v5 group by 1) c on r.case_id = c.id group by 1, 2, 3",
}
QUERIES = {f.__name__: f for f in (score_verdicts, score_questions, score_content, rule_rewrites, route_decisions, route_clauses, route_scores)}
