"""Queries of the order-dependent operators: first occurrence, numbering, rotation, sampling, carried headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.functions.text import normalize_request
from quillmere.session import table


def w1_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that repeat an earlier one after normalization, with the first one's row; an aggregate and a join, so a hot text is no hot window."""
    made = table(spark, sf, "handwritten_v0").where("user_request is not null").select("row_id", F.sha2(normalize_request(F.col("user_request")), 256).alias("k"))
    first = made.groupBy("k").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return made.join(first, "k").where("row_id > first_row").select("row_id", "first_row")


def w2_sequential_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers per split in the order of group and row, with an offset per split.

    The numbers come from counts per group and places within a group, so no window spans a split.
    """
    offset = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2001).otherwise(4001)
    rows = table(spark, sf, "handwritten_v0").where("split in ('train', 'val', 'test') and template_group is not null").select("row_id", "split", "template_group")
    sizes = rows.groupBy("split", "template_group").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("split", "template_group", (F.sum("size").over(W.partitionBy("split").orderBy("template_group")) - F.col("size")).alias("before"))
    place = rows.withColumn("place", F.row_number().over(W.partitionBy("split", "template_group").orderBy("row_id")))
    return place.join(before, ["split", "template_group"]).select("row_id", F.concat(F.lit("DS-"), F.lpad((F.col("before") + F.col("place") - 1 + offset).cast("string"), 8, "0")).alias("sample_id"))


def w3_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """The n-th phrasing takes the question and tag at n modulo their number."""
    each = table(spark, sf, "groups_clarify").where("size(questions) > 0 and size(tags) > 0").select("row_id", "questions", "tags", F.posexplode("phrasings").alias("i", "phrasing"))
    return each.select("row_id", F.col("i").alias("place"), "phrasing", F.element_at("questions", (F.col("i") % F.size("questions") + 1).cast("int")).alias("question"), F.element_at("tags", (F.col("i") % F.size("tags") + 1).cast("int")).alias("tag"))


def w4_stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Of each category every k-th template group, k a twelfth of their number, twelve at most."""
    rows = table(spark, sf, "groups_clarify").select("category", "id", "row_id").withColumn("rn", F.row_number().over(W.partitionBy("category").orderBy("id", "row_id"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("category")))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 12))
    picked = (F.col("rn") - 1) % step == 0
    return rows.where(picked & (F.floor((F.col("rn") - 1) / step) < 12)).select("category", "id", "row_id")


def w5_top_up(spark: SparkSession, sf: str) -> DataFrame:
    """The first two rows of each tool among decisions that call one."""
    tool = F.get_json_object("expected_decision", "$.tool")
    rows = table(spark, sf, "handwritten_v0").select("row_id", tool.alias("tool")).where("tool is not null")
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("tool").orderBy("row_id"))).where("rn <= 2").select("tool", "row_id")


def w6_section_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents under the last heading before them, carried forward within each document."""
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    header = F.when(F.startswith("line", F.lit("## ")), F.substr("line", F.lit(4)))
    carried = lines.withColumn("section", F.last(header, True).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    return carried.where("section is not null").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"))


def w7_distinct_calls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "route_rows").select("row_id", F.array_join(F.array_distinct("calls"), ",").alias("calls"))


SQL = {
    "w1_first_seen": "select row_id, first_row from (select row_id, min(row_id) over (partition by k) as first_row from (select row_id, {k} as k from handwritten_v0 where user_request is not null)) where row_id > first_row",
    "w2_sequential_ids": "select row_id, 'DS-' || lpad(cast(row_number() over (partition by split order by template_group, row_id) - 1 + case split when 'train' then 1 when 'val' then 2001 else 4001 end as varchar), 8, '0') as sample_id from handwritten_v0 where split in ('train', 'val', 'test') and template_group is not null",
    "w3_rotation": "select row_id, cast(i - 1 as int) as place, phrasings[i] as phrasing, questions[(i - 1) % len(questions) + 1] as question, tags[(i - 1) % len(tags) + 1] as tag from (select *, unnest(range(1, len(phrasings) + 1)) as i from groups_clarify where len(questions) > 0 and len(tags) > 0)",
    "w4_stride_sample": "select category, id, row_id from (select category, id, row_id, row_number() over (partition by category order by id, row_id) as rn, greatest(1, count(*) over (partition by category) // 12) as step from groups_clarify) where (rn - 1) % step = 0 and (rn - 1) // step < 12",
    "w5_top_up": "select tool, row_id from (select *, row_number() over (partition by tool order by row_id) as rn from (select row_id, case when json_valid(expected_decision) then json_extract_string(expected_decision, '$.tool') end as tool from handwritten_v0) where tool is not null) where rn <= 2",
    "w6_section_headers": "select doc_id, section, count(*) as lines from (select doc_id, last_value(case when starts_with(line, '## ') then substr(line, 4) end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row) as section from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)) where section is not null group by 1, 2",
    "w7_distinct_calls": "select row_id, array_to_string(list_transform(list_filter(list_zip(calls, range(1, len(calls) + 1)), lambda z: list_position(calls, z[1]) = z[2]), lambda z: z[1]), ',') as calls from route_rows",
}
_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SQL["w1_first_seen"] = SQL["w1_first_seen"].replace("{k}", f"translate(regexp_replace(regexp_replace(user_request, '{_WS}', '', 'g'), '[0-9]+', '#', 'g'), '，。？！、：;“”\"''()（）,.?!%', '')")
QUERIES = {f.__name__: f for f in (w1_first_seen, w2_sequential_ids, w3_rotation, w4_stride_sample, w5_top_up, w6_section_headers, w7_distinct_calls)}
