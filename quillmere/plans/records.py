"""Queries of the data tools over orders, parts, lineitems, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.calc import evaluated
from quillmere.operators.intervals import overlaps
from quillmere.operators.tools import aggregate, convert, lookup, next_id, search, search_many
from quillmere.session import table

SEARCHES = [("q1", "合同 到期"), ("q2", "合同"), ("q3", "router requests"), ("q4", "火星殖民条例"), ("q5", " "), ("q6", "评测集 追问 拒绝")]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records: dataset, amount, status, region, business time.  The dimensions are joined by their keys."""
    orders, customer, nation, region = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), F.col("r_name").alias("region"), F.col("o_orderdate").alias("business_time"))


def t1_search_all_tokens(spark: SparkSession, sf: str) -> DataFrame:
    hits = search(table(spark, sf, "documents"), "合同 到期", ["title", "text"])
    return hits.select("doc_id", "title", F.substring("text", 1, 60).alias("snippet"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm").alias("updated_at"))


def t1_search_batch(spark: SparkSession, sf: str) -> DataFrame:
    queries = spark.createDataFrame(SEARCHES, "query_id string, query string")
    hits = search_many(table(spark, sf, "documents"), queries, ["title", "text"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.min("doc_id").alias("first_doc"))
    return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total"), "first_doc")


def t2_get_record(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    records = table(spark, sf, "orders").select(F.lit("order").alias("record_type"), F.col("o_orderkey").alias("record_id")).unionAll(table(spark, sf, "part").select(F.lit("part").alias("record_type"), F.col("p_partkey").alias("record_id")))
    asked = F.explode(F.array(F.struct(F.lit("order").alias("t"), (F.col("l_orderkey") + F.when(F.col("l_linenumber") > 5, 1000000).otherwise(0)).alias("i")), F.struct(F.lit("part").alias("t"), (F.col("l_partkey") * 2).alias("i")))).alias("r")
    requests = lines.select(asked).select(F.col("r.t").alias("record_type"), F.col("r.i").alias("record_id"))
    return lookup(requests, records, ["record_type", "record_id"]).groupBy("record_type", "status").agg(F.count(F.lit(1)).alias("n"))


def t3_calculate(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    cents, quantity = F.col("l_extendedprice").cast("decimal(14,2)"), F.col("l_quantity").cast("int")
    text = F.concat(F.lit("("), cents.cast("string"), F.lit(" - 12.5%) *"), quantity.cast("string"), F.when(F.col("l_linenumber") == 3, "/0").when(F.col("l_linenumber") == 5, ")").otherwise("+7"))
    made = lines.select("l_orderkey", "l_linenumber", evaluated(text).alias("r"))
    return made.select("l_orderkey", "l_linenumber", F.col("r.value").cast("double").alias("value"), F.col("r.code").alias("code"))


def t4_agg_filtered(spark: SparkSession, sf: str) -> DataFrame:
    period = ("business_time", F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"), F.lit("1996-12-31 23:59:00").cast("timestamp_ntz"))
    return aggregate(_orders(spark, sf), "amount", ["region"], period, {"status": ["F", "O"], "region": ["ASIA", "EUROPE", "AFRICA"]})


def t4_agg_no_data(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate(_orders(spark, sf), "amount", [], None, {"region": ["ATLANTIS"]})


def t4_dataset_matrix(spark: SparkSession, sf: str) -> DataFrame:
    sources = [("orders", "amount", "o_totalprice"), ("lineitem", "quantity", "l_quantity"), ("lineitem", "amount", "l_extendedprice"), ("part", "amount", "p_retailprice"), ("customer", "amount", "c_acctbal")]
    parts = [aggregate(table(spark, sf, t), c).select(F.lit(t).alias("dataset"), F.lit(m).alias("metric"), "*") for t, m, c in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _calendar(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf, "events")
    start = F.col("ts")
    length = F.make_dt_interval(mins=(F.col("event_id") % 90 + 10).cast("int"))
    booked = events.where("event_type in ('click', 'purchase')").select("user_id", F.col("event_id").alias("r_id"), start.alias("r_start"), (start + length).alias("r_end"))
    wanted = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("l_id"), (start + F.expr("interval 10 minutes")).alias("l_start"), (start + F.expr("interval 550 minutes")).alias("l_end"), (F.col("event_id") % 3 == 0).alias("confirmed"))
    return wanted, booked


def t5_availability(spark: SparkSession, sf: str) -> DataFrame:
    wanted, booked = _calendar(spark, sf)
    hits = overlaps(wanted, booked, ["user_id"]).groupBy("l_id").agg(F.count(F.lit(1)).alias("conflicts"), F.min("r_id").alias("first_conflict"))
    return wanted.select("l_id").join(hits, "l_id", "left").select(F.col("l_id").alias("request_id"), F.when(F.col("conflicts").isNull(), "available").otherwise("conflict").alias("status"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), "first_conflict")


def t5_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    _, booked = _calendar(spark, sf)
    left = booked.select("user_id", F.col("r_id").alias("l_id"), F.col("r_start").alias("l_start"), F.col("r_end").alias("l_end"))
    return overlaps(left, booked, ["user_id"]).where("l_id < r_id").select("user_id", F.col("l_id").alias("event_a"), F.col("r_id").alias("event_b"))


def t6_create_event(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade: past, too long, conflict, not confirmed, ok."""
    wanted, booked = _calendar(spark, sf)
    asked = wanted.withColumn("l_end", F.when(F.col("l_id") % 5 == 0, F.col("l_end")).otherwise(F.col("l_start") + F.expr("interval 1 hour")))
    hits = overlaps(asked, booked, ["user_id"]).groupBy("l_id").agg(F.count(F.lit(1)).alias("conflicts"))
    minutes = F.timestamp_diff("MINUTE", F.col("l_start"), F.col("l_end"))
    status = F.when(F.col("l_start") < F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), "rejected_past").when(minutes > 480, "rejected_long").when(F.col("conflicts").isNotNull(), "conflict").when(~F.col("confirmed"), "pending_confirmation").otherwise("ok")
    return asked.join(hits, "l_id", "left").select(F.col("l_id").alias("request_id"), status.alias("status"))


def t6_next_id(spark: SparkSession, sf: str) -> DataFrame:
    return next_id(table(spark, sf, "customer"), "c_name", "EV-", 9)


def t7_sort_records(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 largest orders, ties by key."""
    top = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(20)
    return top


def t8_unit_convert(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    pairs = [("cm", "m"), ("km", "mm"), ("kg", "t"), ("t", "g"), ("mm", "km")]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("from_unit"), F.lit(b).alias("to_unit"), convert(F.col("p_size"), a, b).cast("double").alias("converted")) for a, b in pairs))).alias("e")
    return part.select("p_partkey", each).select("p_partkey", "e.from_unit", "e.to_unit", "e.converted")


def t10_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Results whose (tool, status) isn't registered: events by type and rounded value, against a register."""
    register = spark.createDataFrame([("view", 0), ("view", 1), ("click", 0), ("purchase", 2)], "event_type string, status bigint")
    results = table(spark, sf, "events").select("event_id", "event_type", (F.col("event_id") % 3).alias("status"))
    return results.join(register, ["event_type", "status"], "left_anti").groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


_MEAN = "case when count({c}) = 0 then null else sign(sum(c)) * ((2 * abs(sum(c)) + count(*)) // (2 * count(*))) / 100.0 end"


def _agg_sql(source: str, metric: str, by: str = "") -> str:
    cents = f"cast(round(cast({metric} as decimal(20,2)) * 100) as bigint)"
    keys = f"{by}, " if by else ""
    return f"select {keys}case when count(*) = 0 then 'no_data' else 'ok' end as status, count(*) as n, cast(sum(c) as double) / 100 as sum_value, cast({_MEAN.format(c='c')} as double) as mean_value, cast(min(c) as double) / 100 as min_value, cast(max(c) as double) / 100 as max_value from (select {keys}{cents} as c from {source}) {'group by ' + by if by else ''}"


_RECORDS = "(select o_totalprice as amount, o_orderstatus as status, r_name as region, o_orderdate as business_time from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
_BOOKED = "(select user_id, event_id as r_id, ts as r_start, ts + to_minutes(cast(event_id % 90 + 10 as int)) as r_end from events where event_type in ('click', 'purchase'))"
_WANTED = "(select user_id, event_id as l_id, ts + interval 10 minutes as l_start, ts + interval 550 minutes as l_end, event_id % 3 = 0 as confirmed from events where event_type = 'signup')"
_TEXT = "concat_ws(' ', title, text)"

SQL = {
    "t1_search_all_tokens": f"select doc_id, title, substr(text, 1, 60) as snippet, strftime(updated_at, '%Y-%m-%dT%H:%M') as updated_at from documents where contains({_TEXT}, '合同') and contains({_TEXT}, '到期')",
    "t1_search_batch": "select q.query_id, coalesce(h.total, 0) as total, h.first_doc from (values " + ", ".join(f"('{a}', '{b}')" for a, b in SEARCHES) + f") q(query_id, query) left join (select query_id, count(*) as total, min(doc_id) as first_doc from documents, (values " + ", ".join(f"('{a}', {[t for t in b.split(' ') if t]})" for a, b in SEARCHES if b.strip()) + f") w(query_id, tokens) where len(list_filter(tokens, lambda t: not contains({_TEXT}, t))) = 0 group by 1) h on q.query_id = h.query_id",
    "t2_get_record": "select record_type, case when f is null then 'not_found' else 'ok' end as status, count(*) as n from (select 'order' as record_type, l_orderkey + case when l_linenumber > 5 then 1000000 else 0 end as i from lineitem union all select 'part', l_partkey * 2 from lineitem) r left join (select 'order' as t, o_orderkey as k, 1 as f from orders union all select 'part', p_partkey, 1 from part) x on r.record_type = x.t and r.i = x.k group by 1, 2",
    "t3_calculate": "select l_orderkey, l_linenumber, case when l_linenumber in (3, 5) then null else cast(sign(v) * floor(abs(v) / 10 + 0.5) / 100 as double) end as value, case l_linenumber when 3 then 'division_by_zero' when 5 then 'expression_syntax' end as code from (select l_orderkey, l_linenumber, cast((cast(l_extendedprice as decimal(14,2)) * 1000 - 125) * cast(l_quantity as int) + 7000 as decimal(30,0)) as v from lineitem)",
    "t4_agg_filtered": _agg_sql(f"{_RECORDS} where business_time between timestamp '1996-01-01 00:00:00' and timestamp '1996-12-31 23:59:00' and status in ('F', 'O') and region in ('ASIA', 'EUROPE', 'AFRICA')", "amount", "region"),
    "t4_agg_no_data": _agg_sql(f"{_RECORDS} where region = 'ATLANTIS'", "amount"),
    "t4_dataset_matrix": " union all ".join(f"select '{t}' as dataset, '{m}' as metric, * from ({_agg_sql(t, c)})" for t, m, c in [("orders", "amount", "o_totalprice"), ("lineitem", "quantity", "l_quantity"), ("lineitem", "amount", "l_extendedprice"), ("part", "amount", "p_retailprice"), ("customer", "amount", "c_acctbal")]),
    "t5_availability": f"select l_id as request_id, case when count(r_id) = 0 then 'available' else 'conflict' end as status, count(r_id) as conflicts, min(r_id) as first_conflict from {_WANTED} w left join {_BOOKED} b on w.user_id = b.user_id and l_start < r_end and r_start < l_end group by l_id",
    "t5_overlap_pairs": f"select a.user_id, a.r_id as event_a, b.r_id as event_b from {_BOOKED} a join {_BOOKED} b on a.user_id = b.user_id and a.r_id < b.r_id and a.r_start < b.r_end and b.r_start < a.r_end",
    "t6_create_event": f"select l_id as request_id, case when l_start < timestamp '2024-01-05' then 'rejected_past' when date_diff('minute', l_start, e) > 480 then 'rejected_long' when exists (select 1 from {_BOOKED} b where b.user_id = w.user_id and w.l_start < b.r_end and b.r_start < w.e) then 'conflict' when not confirmed then 'pending_confirmation' else 'ok' end as status from (select *, case when l_id % 5 = 0 then l_end else l_start + interval 1 hour end as e from {_WANTED}) w",
    "t6_next_id": "select 'EV-' || lpad(cast(max(cast(regexp_extract(c_name, '([0-9]+)$', 1) as bigint)) + 1 as varchar), 9, '0') as next_id from customer",
    "t7_sort_records": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
    "t8_unit_convert": "select p_partkey, a as from_unit, b as to_unit, cast(cast(p_size as double) * f / t as double) as converted from part, (values ('cm', 'm', 10, 1000), ('km', 'mm', 1000000, 1), ('kg', 't', 1000, 1000000), ('t', 'g', 1000000, 1), ('mm', 'km', 1, 1000000)) u(a, b, f, t)",
    "t10_envelope": "select event_type, event_id % 3 as status, count(*) as n from events where (event_type, event_id % 3) not in (('view', 0), ('view', 1), ('click', 0), ('purchase', 2)) group by 1, 2",
}
QUERIES = {f.__name__: f for f in (t1_search_all_tokens, t1_search_batch, t2_get_record, t3_calculate, t4_agg_filtered, t4_agg_no_data, t4_dataset_matrix, t5_availability, t5_overlap_pairs, t6_create_event, t6_next_id, t7_sort_records, t8_unit_convert, t10_envelope)}
