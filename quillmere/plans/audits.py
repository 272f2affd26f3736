"""Queries of dataset audits and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.text import normalize_request, split_name, time_value
from quillmere.functions.timeexpr import resolved
from quillmere.operators.audit import input_drift, leaks, manifest_check, projection_codes, review_faults, table_digest
from quillmere.operators.generate import doubled, expand_groups, product, response_labels
from quillmere.operators.lints import group_design
from quillmere.operators.similarity import shape_classes, similar_pairs
from quillmere.operators.tools import offered_tools
from quillmere.plans.contracts import TOOLS, split_sql
from quillmere.plans.extras import LINES, generate_pairs
from quillmere.plans.extras import SQL as EXTRA_SQL
from quillmere.plans.windows import w4_stride_sample
from quillmere.session import scratch, settle, table
from quillmere.sources.files import markdown_lines

FORBIDDEN = ["expected_decision", "refuse_code", "clarify_target", "record_id", "post_condition"]
#: Moments from which samples take theirs in turn.
NOW_POOL = ["2026-05-01T09:00", "2026-05-14T16:30", "2026-12-31T23:00"]


def audit_similar_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Template groups with nearly the same label, with the audit's limit on the difference in size."""
    groups = table(spark, sf, "groups_clarify")
    return similar_pairs(groups, None, "row_id", "label", 0.78, 24).select("a", "b", F.bround("similarity", 4).alias("similarity"))


def audit_title_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a title close to the label of a template group."""
    groups = table(spark, sf, "groups_clarify").select(F.col("row_id").alias("id"), F.col("label").alias("words"))
    titles = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("title").alias("words"))
    return similar_pairs(groups, titles, "id", "words", 0.6).select(F.col("a").alias("group_row"), F.col("b").alias("doc_id"), F.bround("similarity", 4).alias("similarity"))


def audit_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that are the same characters in another order."""
    return shape_classes(table(spark, sf, "handwritten_v0"), "row_id", "user_request").where("members > 1")


def audit_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Normalized requests that stand in several splits."""
    rows = table(spark, sf, "handwritten_v0").where("user_request is not null and split is not null").select("split", F.sha2(normalize_request(F.col("user_request")), 256).alias("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits"), F.countDistinct("split").alias("different")).where("different > 1").select("k", "n", "splits")


def audit_leaked_names(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", F.explode(leaks(F.col("text"), FORBIDDEN)).alias("name"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


def audit_review_closure(spark: SparkSession, sf: str) -> DataFrame:
    """A review log of the stride sample of all template groups, written as a Markdown file and read again, against the sample.

    In the log a group's number says what became of it: a third is checked, a third is not, a third is missing, and each
    group checked has one beside it that was never sampled.  The log has a section for each category and one for findings, which is empty.
    """
    sampled = settle(w4_stride_sample(spark, sf).select(F.coalesce("category", F.lit("none")).alias("section"), "id"), "sampled")
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    boxes = sampled.select("section", "id", number.alias("k")).where("k % 3 < 2")
    lines = boxes.select("section", F.concat(F.when(F.col("k") % 3 == 0, F.lit("- [x] ")).otherwise(F.lit("- [ ] ")), "id", F.lit(" 已看")).alias("line"))
    phantoms = boxes.where("k % 3 = 0").select("section", F.concat(F.lit("- [X] TG-9"), "k").alias("line"))
    # a dozen groups a category, so a log is small
    each = lines.unionAll(phantoms).groupBy("section").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    text = each.agg(F.concat(F.lit("# 抽检\n"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("## "), "section", F.lit("\n"), "body"))), "\n"), F.lit("\n## findings\n\n")).alias("value"))
    path = scratch(spark, "review")
    text.coalesce(1).write.text(path)
    return review_faults(markdown_lines(spark, path), sampled, 10, "findings")


#: Tables that are frozen, with all their columns and how each is written as text: s as it is, d a double, t a moment, a an array of
#: strings, c the context of a case, f the fields that a case asks about.
FROZEN = {
    "handwritten_v0": "row_id:s id:s user_request:s available_tools:a context:c expected_decision:s rationale:s tags:a template_group:s source:s split:s category:s seed:s clarify_target:f refuse_code:s post_condition:s batch_no:s created_at:t received_at:t",
    "groups_clarify": "row_id:s id:s slug:s label:s toolset:s action:s tool:s category:s tags:a clarify_target:f phrasings:a questions:a rationale:s split:s updated_at:t",
    "agent_route_pairwise_v5": "row_id:s id:s query:s expected_routes:a category:s writes_data:s created_at:t",
    "route_rows": "row_id:s case_id:s adapter_version:s routes:a calls:a reason:s error:s model_latency_ms:d latency_ms:d correct:s run_day:s recorded_at:t ingested_at:t",
    "frozen_probes": "id:s query:s expected_routes:a category:s",
    "documents": "doc_id:s title:s text:s lang:s source:s author:s n_chars:s updated_at:t",
    "mix_targets": "source:s target_share:d max_repeats:s",
    "region": "r_regionkey:s r_name:s",
    "nation": "n_nationkey:s n_name:s n_regionkey:s",
}


def audit_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and digests of tables, to freeze them: every row with every column."""
    out = None
    for name in FROZEN:
        one = table_digest(table(spark, sf, name)).select(F.lit(name).alias("name"), "n", "digest")
        out = one if out is None else out.unionAll(one)
    return out


def audit_manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    """Cases as first delivered, frozen by category, against the same cases as last delivered: which categories are no longer what was frozen."""
    cases = table(spark, sf, "handwritten_v0").where("id is not null")
    columns = sorted(set(cases.columns) - {"row_id", "batch_no", "created_at", "received_at", "category"})
    whole = F.struct("row_id", F.coalesce("category", F.lit("none")).alias("name"), *columns)
    ends = cases.groupBy("id").agg(F.min_by(whole, "row_id").alias("first"), F.max_by(whole, "row_id").alias("last"))
    sides = [table_digest(ends.select(f"{side}.*"), columns, ["name"]) for side in ("first", "last")]
    return manifest_check(*sides)


def _rendered(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with the text that a model would see of them."""
    lines = F.create_map(*(F.lit(x) for kv in LINES.items() for x in kv))
    tools = F.array_join(F.transform("available_tools", lambda t: F.concat(t, F.coalesce(lines[t], F.lit("()")))), "\n")
    return table(spark, sf, "handwritten_v0").withColumn("input", F.concat_ws("\n", tools, F.concat(F.lit("now: "), "context.now"), F.concat(F.lit("request: "), "user_request")))


def audit_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered inputs that give away their case's group, tags, category, source, seed or gold answer, or that lack the request."""
    rows = _rendered(spark, sf)
    secrets = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("template_group", "category", F.col("seed").cast("string")))
    answer = F.coalesce(F.get_json_object("expected_decision", "$.question"), F.get_json_object("expected_decision", "$.reason"))
    return rows.select("row_id", F.explode(projection_codes(F.col("input"), F.col("user_request"), FORBIDDEN, secrets, answer)).alias("code"))


def audit_input_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Cases whose input, as rendered at their first delivery, isn't what their last delivery renders to."""
    ends = _rendered(spark, sf).where("id is not null").groupBy("id").agg(F.min_by(F.struct("input"), "row_id").alias("first"), F.max_by(F.struct("input"), "row_id").alias("last"))
    return input_drift(ends.select("id", "first.input"), ends.select("id", "last.input"))


def s1_sorted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of template groups with similar labels, sorted by the whole tuple, falling."""
    pairs = similar_pairs(table(spark, sf, "groups_clarify"), None, "row_id", "label", 0.6).select(F.bround("similarity", 4).alias("similarity"), "a", "b")
    return pairs.orderBy(*(F.desc(c) for c in pairs.columns))


def s2_top_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most similar pairs."""
    return s1_sorted_pairs(spark, sf).limit(20)


def s6_sorted_json(spark: SparkSession, sf: str) -> DataFrame:
    """Route cases as JSON with keys in order of name, nulls left out."""
    rows = table(spark, sf, "agent_route_pairwise_v5").select("row_id", "id", "query", "category", "writes_data").where("id is not null and query is not null and category is not null and writes_data is not null")
    return rows.select("row_id", F.to_json(F.struct(*sorted(rows.columns))).alias("json"))


#: Tools of the groups' toolsets.
TOOLSETS = {"train6": TOOLS, "train4": TOOLS[:4], "unseen2": ["unit_convert", "sort_records"]}


def t11_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Template groups with the tools that their toolset offers, by a map literal."""
    offered = offered_tools(F.col("toolset"), TOOLSETS)
    return table(spark, sf, "groups_clarify").select("row_id", F.array_join(offered, ",").alias("tools"), F.coalesce(F.array_contains(offered, F.col("clarify_target.tool")), F.lit(False)).alias("offers_target"))


def v24_group_design(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of the design of template groups."""
    none = F.lit(None)
    g = {"split": split_name(F.col("split")), "toolset": F.col("toolset"), "action": F.col("action"), "tool": F.col("tool"), "offered": offered_tools(F.col("toolset"), TOOLSETS), "target_tool": F.col("clarify_target.tool"), "refuse_code": none.cast("string"), "blocking": none.cast("array<string>"), "phrasings": F.col("phrasings")}
    return table(spark, sf, "groups_clarify").select("row_id", F.explode(group_design(g, TOOLS, TOOLSETS["unseen2"])).alias("code"))


def generate_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with their split, their tools, a moment from a pool and a start after it: so many days on as the sample's place says, at ten."""
    pool = F.array(*(F.lit(x) for x in NOW_POOL))
    each = table(spark, sf, "groups_clarify").select("row_id", "id", split_name(F.col("split")).alias("split"), offered_tools(F.col("toolset"), TOOLSETS).alias("offered"), F.posexplode("phrasings").alias("place", "phrasing"))
    now = F.element_at(pool, (F.col("place") % len(NOW_POOL) + 1).cast("int"))
    made = each.withColumn("now", now).withColumn("start", resolved(time_value(F.col("now")), days=F.col("place") + 1, clock=F.lit("10:00")))
    # a start that isn't after its moment is an error of the design
    later = F.when(F.col("start") > F.col("now"), F.col("start")).otherwise(F.raise_error(F.lit("start before now")).cast("string"))
    return made.select("row_id", "place", "split", F.size("offered").alias("tools"), "now", later.alias("start"), F.replace(F.concat(F.lit("在<start>之前，"), "phrasing"), F.lit("<start>"), F.col("start")).alias("request"))


def generate_contrastive(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of phrasings with and without their record number whose own answer scores as right, and of which no side is, numbers and punctuation apart, a request that there is already."""
    pairs = generate_pairs(spark, sf)
    right = F.col("request").rlike("(DD|FP|HT|SH)[0-9]{6}") == (F.col("kind") == "complete")
    known = table(spark, sf, "handwritten_v0").where("user_request is not null").select(F.sha2(normalize_request(F.col("user_request")), 256).alias("k")).distinct()
    checked = pairs.withColumn("k", F.sha2(normalize_request(F.col("request")), 256)).join(known.withColumn("_known", F.lit(1)), "k", "left")
    fine = checked.groupBy("row_id", "place").agg(F.count_if(~right).alias("wrong"), F.count("_known").alias("known"), F.countDistinct("k").alias("sides"))
    kept = fine.where("wrong = 0 and known = 0 and sides = 2").select("row_id", "place")
    return pairs.join(kept, ["row_id", "place"], "left_semi")


def generate_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance sets by split: cases whose gold decision is in form and answers itself, with the digests of samples and of inputs that freeze them."""
    rows = _rendered(spark, sf).withColumn("part", split_name(F.col("split"))).where("part is not null and input is not null and user_request is not null")
    action = F.get_json_object("expected_decision", "$.action")
    fine = F.when(action == "call", F.get_json_object("expected_decision", "$.tool").isNotNull()).when(action == "clarify", F.get_json_object("expected_decision", "$.question").isNotNull()).when(action == "refuse", F.get_json_object("expected_decision", "$.reason").isNotNull())
    chosen = rows.where(F.coalesce(fine, F.lit(False))).groupBy("id").agg(F.min_by(F.struct("part", "user_request", "expected_decision", "input"), "row_id").alias("c")).select("id", "c.*")
    samples = table_digest(chosen, ["expected_decision", "id", "user_request"], ["part"]).withColumnRenamed("digest", "dataset_digest")
    return samples.join(table_digest(chosen, ["id", "input"], ["part"]).select("part", F.col("digest").alias("input_digest")), "part")


def generate_samples(spark: SparkSession, sf: str) -> DataFrame:
    return expand_groups(table(spark, sf, "groups_clarify"))


def generate_product(spark: SparkSession, sf: str) -> DataFrame:
    """Requests from parts: regions, order priorities and verbs."""
    verbs = spark.createDataFrame([("查一下",), ("统计",), ("导出",)], "verb string")
    regions = table(spark, sf, "region").select("r_name")  # 5 rows
    flags = table(spark, sf, "orders").select("o_orderpriority").distinct()
    made = product(verbs, regions, flags)
    return made.select(F.concat_ws(" ", "verb", "r_name", "o_orderpriority").alias("request"), F.sha2(F.concat_ws(" ", "verb", "r_name", "o_orderpriority"), 256).alias("request_sha256"))


def generate_doubled(spark: SparkSession, sf: str) -> DataFrame:
    return doubled(table(spark, sf, "agent_route_pairwise_v5").select("row_id", "query"), "query", "麻烦")


def generate_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label masks over the sizes of requests: prompts of one id per character, answers of one per tag."""
    rows = table(spark, sf, "handwritten_v0").where("user_request is not null and tags is not null and length(user_request) + size(tags) >= 3")
    prompt = F.array_repeat(F.lit(7), F.length("user_request"))
    answer = F.transform("tags", lambda t: F.length(t))
    return rows.select("row_id", response_labels(prompt, answer, 1280).alias("labels")).select("row_id", F.size("labels").alias("n"), F.array_join(F.slice(F.col("labels"), -3, 3).cast("array<string>"), ",").alias("tail"), F.size(F.filter("labels", lambda x: x == -100)).alias("masked"))


_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORMAL = f"translate(regexp_replace(regexp_replace(user_request, '{_WS}', '', 'g'), '[0-9]+', '#', 'g'), '，。？！、：;“”\"''()（）,.?!%', '')"


def _sets(source: str, key: str, text: str) -> str:
    return f"select {key} as id, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) as g from (select {key}, regexp_replace({text}, '{_WS}', '', 'g') as s from {source} where {text} is not null) where length(s) > 1"


_J = "round_even(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 4)"
_JL = "len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))"


_AS_TEXT = {
    "s": "cast({0} as varchar)",
    "d": "cast(cast(floor({0} * 1000000 + 0.5) as bigint) as varchar)",
    "t": "cast(epoch_us({0}) as varchar)",
    "a": "'[' || array_to_string(list_transform({0}, lambda x: coalesce(x, chr(30))), ',') || ']'",
    "c": "case when {0} is not null then concat_ws(chr(29), coalesce({0}.now, chr(30)), coalesce(cast({0}.user_confirmed_write as varchar), chr(30)), coalesce('[' || array_to_string(list_transform({0}.conversation, lambda x: concat_ws(chr(29), coalesce(x.role, chr(30)), coalesce(x.content, chr(30)))), ',') || ']', chr(30))) end",
    "f": "case when {0} is not null then concat_ws(chr(29), coalesce({0}.tool, chr(30)), coalesce('[' || array_to_string(list_transform({0}.fields, lambda x: coalesce(x, chr(30))), ',') || ']', chr(30))) end",
}


def _row_sql(columns: str, prefix: str = "") -> str:
    """The digest of a row of some columns (name:kind), in order of name."""
    parts = ", ".join(f"coalesce({_AS_TEXT[kind].format(prefix + name)}, chr(30))" for name, kind in sorted(c.split(":") for c in columns.split()))
    return f"cast(('0x' || substr(sha256(concat_ws(chr(31), {parts})), 1, 15)) as bigint)"


def _digest(name: str) -> str:
    return f"select '{name}' as name, count(*) as n, cast(sum({_row_sql(FROZEN[name])}) as varchar) as digest from {name}"


_INPUT = "concat_ws(chr(10), array_to_string(list_transform(available_tools, lambda t: t || case t " + " ".join(f"when '{k}' then '{v}'" for k, v in LINES.items()) + " else '()' end), chr(10)), 'now: ' || context.now, 'request: ' || user_request)"
_KEPT = " ".join(c for c in FROZEN["handwritten_v0"].split() if c.split(":")[0] not in ("row_id", "batch_no", "created_at", "received_at", "category"))
_GOLD = "(case when json_valid(expected_decision) then json_extract_string(expected_decision, '$.{0}') end)"
_OFFERED = "case toolset " + " ".join(f"when '{k}' then {v}" for k, v in TOOLSETS.items()) + " end"
_PAIRS = f"select x.id as a, y.id as b, {_J} as similarity from s x join s y on x.id < y.id where {_JL} >= 0.6 - 1e-12"
SQL = {
    "audit_similar_labels": f"with s as ({_sets('groups_clarify', 'row_id', 'label')}) select x.id as a, y.id as b, {_J} as similarity from s x join s y on x.id < y.id and abs(len(x.g) - len(y.g)) <= 24 where {_JL} >= 0.78 - 1e-12",
    "audit_title_overlap": f"with p as ({_sets('groups_clarify', 'row_id', 'label')}), c as ({_sets('documents', 'doc_id', 'title')}) select x.id as group_row, y.id as doc_id, {_J} as similarity from p x, c y where {_JL} >= 0.6 - 1e-12",
    "audit_shapes": f"with s as (select row_id as id, sha256(array_to_string(list_sort(regexp_extract_all({_NORMAL}, '(?s).')), '')) as h from handwritten_v0 where user_request is not null) select id, class, members from (select id, min(id) over (partition by h) as class, count(*) over (partition by h) as members from s) where members > 1",
    "audit_exact_duplicates": f"select k, count(*) as n, array_to_string(list_sort(list_distinct(list(split))), '|') as splits from (select split, sha256({_NORMAL}) as k from handwritten_v0 where user_request is not null and split is not null) group by 1 having count(distinct split) > 1",
    "audit_leaked_names": f"select name, count(*) as documents, min(doc_id) as first_doc from documents, (select unnest({FORBIDDEN}) as name) where contains(text, name) group by 1",
    "audit_review_closure": """with s as (select coalesce(category, 'none') as section, id, cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) as k from (select category, id, row_number() over (partition by category order by id, row_id) as rn, greatest(1, count(*) over (partition by category) // 12) as step from groups_clarify) where (rn - 1) % step = 0 and (rn - 1) // step < 12),
        u as (select distinct id, k from s), d as (select section, count(distinct id) as asked, count(distinct id) filter (k % 3 = 0) + count(distinct k) filter (k % 3 = 0) as done from s group by 1)
        select id, case k % 3 when 1 then 'UNCHECKED' else 'MISSING' end as code from u where k % 3 > 0 union all select distinct 'TG-9' || k, 'PHANTOM' from s where k % 3 = 0 and 'TG-9' || k not in (select id from s)
        union all select section, 'SHORT' from d where done < least(10, asked) union all select 'findings', 'FINDINGS_EMPTY'""",
    "audit_manifest": " union all ".join(map(_digest, FROZEN)),
    "audit_manifest_check": f"with e as (select *, row_number() over (partition by id order by row_id) as a, row_number() over (partition by id order by row_id desc) as z from handwritten_v0 where id is not null), f as (select coalesce(category, 'none') as name, count(*) as n, sum({_row_sql(_KEPT)}) as digest from e where a = 1 group by 1), l as (select coalesce(category, 'none') as name, count(*) as n, sum({_row_sql(_KEPT)}) as digest from e where z = 1 group by 1) select * from (select coalesce(f.name, l.name) as name, case when l.name is null then 'FROZEN_MISSING' when f.name is null then 'NOT_FROZEN' when f.n <> l.n or f.digest <> l.digest then 'FROZEN_DRIFT' end as code from f full outer join l on f.name = l.name) where code is not null",
    "audit_projection": f"select row_id, unnest(list_filter([case when len(list_filter({FORBIDDEN}, lambda f: contains(i, f))) > 0 or len(list_filter(coalesce(tags, []) || [template_group, category, cast(seed as varchar)], lambda x: x is not null and x <> '' and contains(i, x))) > 0 then 'GOLD_LEAK' end, case when a <> '' and contains(i, a) then 'GOLD_ANSWER_LEAK' end, case when not contains(i, user_request) then 'REQUEST_MISSING' end], lambda v: v is not null)) as code from (select *, {_INPUT} as i, coalesce({_GOLD.format('question')}, {_GOLD.format('reason')}) as a from handwritten_v0)",
    "audit_input_drift": f"select id, 'INPUT_DRIFT' as code from (select id, arg_min_null(i, row_id) as f, arg_max_null(i, row_id) as l from (select id, row_id, {_INPUT} as i from handwritten_v0 where id is not null) group by 1) where f is distinct from l",
    "s1_sorted_pairs": f"with s as ({_sets('groups_clarify', 'row_id', 'label')}) {_PAIRS} order by similarity desc, a desc, b desc",
    "s2_top_pairs": f"with s as ({_sets('groups_clarify', 'row_id', 'label')}) {_PAIRS} order by similarity desc, a desc, b desc limit 20",
    "s6_sorted_json": "select row_id, cast(to_json({'category': category, 'id': id, 'query': query, 'row_id': row_id, 'writes_data': writes_data}) as varchar) as json from agent_route_pairwise_v5 where id is not null and query is not null and category is not null and writes_data is not null",
    "t11_profiles": f"select row_id, array_to_string(o, ',') as tools, coalesce(list_contains(o, clarify_target.tool), false) as offers_target from (select *, {_OFFERED} as o from groups_clarify)",
    "v24_group_design": f"select row_id, unnest(list_filter([case when toolset = 'unseen2' and s <> 'unseen_test' then 'UNSEEN_SPLIT' end, case when toolset <> 'unseen2' and s = 'unseen_test' then 'SPLIT_MISUSE' end, case when toolset <> 'unseen2' and (tool in ('unit_convert', 'sort_records') or list_has_any(o, ['unit_convert', 'sort_records'])) then 'UNSEEN_LEAK' end, case when action = 'call' and not coalesce(list_contains(o, tool), false) then 'TOOL_NOT_OFFERED' end, case when clarify_target.tool is not null and not coalesce(list_contains(o, clarify_target.tool), false) then 'TARGET_NOT_OFFERED' end, case when coalesce(len(phrasings), 0) < 2 then 'GROUP_TOO_SMALL' end, case when len(list_distinct(phrasings)) < len(phrasings) then 'PHRASING_REPEATED' end], lambda v: v is not null)) as code from (select *, {split_sql('split')} as s, {_OFFERED} as o from groups_clarify)",
    "generate_resolved": f"select row_id, cast(p as int) as place, s as split, cast(len(o) as int) as tools, n as now, st as start, '在' || st || '之前，' || x as request from (select *, strftime(cast(substr(n, 1, 10) as date) + cast(p + 1 as int), '%Y-%m-%dT10:00') as st from (select row_id, i - 1 as p, phrasings[i] as x, {split_sql('split')} as s, {_OFFERED} as o, {NOW_POOL}[(i - 1) % {len(NOW_POOL)} + 1] as n from (select *, unnest(range(1, len(phrasings) + 1)) as i from groups_clarify)))",
    "generate_contrastive": f"with p as ({EXTRA_SQL['generate_pairs']}), k as (select distinct sha256({_NORMAL}) as k from handwritten_v0 where user_request is not null), c as (select p.*, sha256({_NORMAL.replace('user_request', 'request')}) as k, regexp_matches(request, '(DD|FP|HT|SH)[0-9]{{6}}') = (kind = 'complete') as fine from p) select row_id, place, kind, request from c where (row_id, place) in (select (row_id, place) from c left join k on c.k = k.k group by row_id, place having count(*) filter (not fine) = 0 and count(k.k) = 0 and count(distinct c.k) = 2)",
    "generate_acceptance": f"with c as (select id, arg_min({{'p': p, 'user_request': user_request, 'expected_decision': expected_decision, 'input': i}}, row_id) as c from (select *, {split_sql('split')} as p, {_INPUT} as i from handwritten_v0) where p is not null and user_request is not null and case {_GOLD.format('action')} when 'call' then {_GOLD.format('tool')} is not null when 'clarify' then {_GOLD.format('question')} is not null when 'refuse' then {_GOLD.format('reason')} is not null end group by 1), r as (select id, c.p as part, c.user_request as user_request, c.expected_decision as expected_decision, c.input as input from c) select part, count(*) as n, cast(sum({_row_sql('id:s user_request:s expected_decision:s')}) as varchar) as dataset_digest, cast(sum({_row_sql('id:s input:s')}) as varchar) as input_digest from r group by 1",
    "generate_samples": r"select id, category, cast(i - 1 as int) as place, regexp_replace(regexp_replace(phrasings[i], '([一-鿿])([0-9A-Za-z])', '\1 \2', 'g'), '([0-9A-Za-z])([一-鿿])', '\1 \2', 'g') as request, case when len(questions) > 0 then questions[(i - 1) % greatest(len(questions), 1) + 1] end as question from (select *, unnest(range(1, len(phrasings) + 1)) as i from groups_clarify)",
    "generate_product": "select v || ' ' || r_name || ' ' || p as request, sha256(v || ' ' || r_name || ' ' || p) as request_sha256 from (values ('查一下'), ('统计'), ('导出')) t(v), region, (select distinct o_orderpriority as p from orders)",
    "generate_doubled": "select row_id, unnest([query, '麻烦' || query]) as query from agent_route_pairwise_v5",
    "generate_labels": "select row_id, cast(length(user_request) + len(tags) as int) as n, array_to_string((list_transform(range(greatest(0, 3 - len(tags))), lambda x: '-100') || list_transform(tags, lambda t: cast(length(t) as varchar)))[-3:], ',') as tail, cast(length(user_request) as int) as masked from handwritten_v0 where user_request is not null and tags is not null and length(user_request) + len(tags) >= 3",
}
QUERIES = {f.__name__: f for f in (audit_similar_labels, audit_title_overlap, audit_shapes, audit_exact_duplicates, audit_leaked_names, audit_review_closure, audit_manifest, audit_manifest_check, audit_projection, audit_input_drift, s1_sorted_pairs, s2_top_pairs, s6_sorted_json, t11_profiles, v24_group_design, generate_resolved, generate_contrastive, generate_acceptance, generate_samples, generate_product, generate_doubled, generate_labels)}
