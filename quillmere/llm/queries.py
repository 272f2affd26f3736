"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.llm.bytepairs import token_ids
from quillmere.llm.canon import canonical_dense
from quillmere.llm.components import components
from quillmere.llm.crosssplit import cross_split
from quillmere.llm.groupsplits import assign, record_components
from quillmere.llm.history import already_accepted
from quillmere.llm.lookalike import look_alike_groups, look_alike_pairs
from quillmere.llm.mixture import mixture
from quillmere.llm.neardup import groups, near_duplicates, row_pairs
from quillmere.llm.quantiles import merged, percentiles, ranked_rows, sketches
from quillmere.llm.requests import group_number, plain_name, request_rows, row_id, split_name, table_name
from quillmere.llm.residue import residue_documents
from quillmere.session import settle, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = row_pairs(*near_duplicates(request_rows(spark, sf_dir)))
    return found.select(table_name("ua").alias("tbl"), row_id("ua").alias("row_a"), row_id("ub").alias("row_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(*near_duplicates(request_rows(spark, sf_dir)))
    return found.select(table_name("uid").alias("tbl"), row_id("uid").alias("row_id"), row_id("rep").alias("class_id"), "copies", "links")


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "handwritten_v0").select(F.col("row_id").alias("uid"), split_name(F.col("split")).alias("split"), F.col("user_request").cast("string").alias("text"))
    return rows.select("uid", F.when(F.col("split") == "train", 1).when(F.col("split").isNotNull(), 2).otherwise(0).alias("side"), "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "handwritten_v0").select(F.col("row_id").alias("uid"), F.col("batch_no").alias("batch"), F.col("user_request").cast("string").alias("text"))
    return already_accepted(rows).select(F.col("uid").alias("row_id"), F.col("match").alias("match_row_id"))


SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches(table(spark, sf_dir, "route_rows"), ["adapter_version", "run_day"], "latency_ms")


def _spread(found: DataFrame, groups: list[str]) -> DataFrame:
    at = [F.col("at")[i].alias("p" + f"{q * 100:g}".replace(".", "_")) for i, q in enumerate(SHARES)]
    return found.select(*groups, "n", "low", *at, "high")


def p3_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result with its percentile among its version's latencies, and the version's median."""
    versions = settle(merged(_daily(spark, sf_dir), ["adapter_version"]), "versions")
    ranked = ranked_rows(table(spark, sf_dir, "route_rows"), "row_id", "adapter_version", "latency_ms", versions)
    return ranked.select("row_id", "adapter_version", "latency_ms", F.round("rank", 6).alias("rank"), (F.col("rank") > 0.99).alias("slowest_percent"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each version, from sketches of its days."""
    return _spread(percentiles(merged(_daily(spark, sf_dir), ["adapter_version"]), ["adapter_version"], SHARES), ["adapter_version"])


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each version and day."""
    return _spread(percentiles(_daily(spark, sf_dir), ["adapter_version", "run_day"], SHARES), ["adapter_version", "run_day"])


def p3_rank_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the rank of each estimate lies from its share, counted over all rows, with the share that the bound allows."""
    groups = ["adapter_version"]
    found = settle(percentiles(merged(_daily(spark, sf_dir), groups), groups, SHARES), "percentiles").withColumnRenamed("adapter_version", "version")
    rows = table(spark, sf_dir, "route_rows").where("latency_ms is not null").select("adapter_version", "latency_ms")
    joined = rows.join(found, F.col("adapter_version").eqNullSafe(F.col("version")))
    counts = [(F.count(F.when(F.col("latency_ms") <= F.col("at")[i], 1)), F.count(F.when(F.col("latency_ms") < F.col("at")[i], 1))) for i in range(len(SHARES))]
    ranks = joined.groupBy("adapter_version").agg(F.count(F.lit(1)).alias("n"), *(c.alias(f"{k}{i}") for i, two in enumerate(counts) for k, c in zip(("le", "lt"), two, strict=True)))
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("share"), (F.col(f"le{i}") / F.col("n")).alias("le"), (F.col(f"lt{i}") / F.col("n")).alias("lt")) for i, q in enumerate(SHARES)))).alias("e")
    off = F.greatest(F.col("e.lt") - F.col("e.share"), F.col("e.share") - F.col("e.le"), F.lit(0.0))
    return ranks.select("adapter_version", "n", each).select("adapter_version", "n", "e.share", off.alias("rank_error"), (F.lit(0.02) * (1 - F.col("e.share")) + 1 / F.col("n")).alias("allowed"))


def _group_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of handwritten_v0 with the written form of their group, links from written forms to numbers, and splits of written forms."""
    cases = table(spark, sf_dir, "handwritten_v0").select("row_id", F.concat(F.lit("written:"), "template_group").alias("name"), group_number(F.col("template_group")).alias("number"), split_name(F.col("split")).alias("split"))
    groups = table(spark, sf_dir, "groups_clarify").select(F.concat(F.lit("written:"), "id").alias("name"), group_number(F.col("id")).alias("number"), split_name(F.col("split")).alias("split"))
    both = settle(cases.select("name", "number", "split").unionAll(groups).where("number is not null").distinct(), "written")
    # a number sorts before the written forms, so it names the component
    links = both.select(F.col("name").alias("u"), F.concat(F.lit("TG-"), "number").alias("v"))
    return cases, links, both.select("name", "split").where("split is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, splits = _group_links(spark, sf_dir)
    named = components(links)
    torn = splits.join(named.hint("merge"), splits["name"] == named["node"]).groupBy("component").agg(F.countDistinct("split").alias("splits")).where("splits > 1")
    return torn.select(F.col("component").alias("template_group"))


def p4_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its component and the split of the component."""
    cases, links, _ = _group_links(spark, sf_dir)
    return assign(settle(record_components(cases.select("row_id", F.when(F.col("number").isNotNull(), F.col("name")).alias("name")), links), "components"))


def p4_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its component and split where rows also belong together that have the same request under several groups: chains of any length."""
    named = _group_links(spark, sf_dir)[0].select("row_id", F.when(F.col("number").isNotNull(), F.concat(F.lit("TG-"), "number")).alias("group"))
    texts = table(spark, sf_dir, "handwritten_v0").select("row_id", canonical_dense(F.col("user_request").cast("string")).alias("form"))
    keys = texts.where("form <> ''").select("row_id", F.concat(F.lit("text:"), F.hex(F.xxhash64("form")), F.hex(F.xxhash64(F.lit(7), "form"))).alias("text"))
    rows = settle(named.join(keys, "row_id", "left"), "linked")
    links = rows.where("group is not null and text is not null").select(F.col("group").alias("u"), F.col("text").alias("v"))
    records = rows.select("row_id", F.coalesce("group", "text").alias("name"))
    alone = records.where("name is not null").select(F.col("name").alias("u"), F.col("name").alias("v"))
    return assign(settle(record_components(records, links.unionAll(alone)), "components"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and groups of each split, and its share."""
    done = p4_assign(spark, sf_dir)
    sums = done.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("component").alias("n_groups"))
    return sums.select("split", "n_rows", "n_groups", (F.col("n_rows") / F.sum("n_rows").over(W.partitionBy(F.lit(1)))).alias("share"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_split(_split_rows(spark, sf_dir))
    return found.select(F.least("train_uid", "eval_uid").alias("row_a"), F.greatest("train_uid", "eval_uid").alias("row_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each evaluation split and source: rows, rows that overlap with training, and overlapping pairs."""
    cases = table(spark, sf_dir, "handwritten_v0").select(F.col("row_id").alias("eval_uid"), split_name(F.col("split")).alias("eval_split"), plain_name(F.col("source")).alias("eval_source"))
    hits = cross_split(_split_rows(spark, sf_dir)).groupBy("eval_uid").agg(F.count(F.lit(1)).alias("pairs"))
    return (
        cases.where("eval_split <> 'train'")
        .join(hits, "eval_uid", "left")
        .groupBy("eval_split", "eval_source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("pairs").alias("overlapping_rows"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("overlapping_pairs"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = look_alike_pairs(request_rows(spark, sf_dir))
    return found.select(table_name("ua").alias("tbl"), row_id("ua").alias("row_a"), row_id("ub").alias("row_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that looks like another one and is written differently, with its class."""
    found = look_alike_groups(request_rows(spark, sf_dir))
    return found.select(table_name("uid").alias("tbl"), row_id("uid").alias("row_id"), row_id("class").alias("class_id"), "members", "spellings")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", plain_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    return mixture(docs, table(spark, sf_dir, "mix_targets").select(plain_name(F.col("source")).alias("source"), "target_share", "max_repeats"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each text is used."""
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_groups, p2_found, p3_ranks, p3_percentiles, p3_daily, p3_rank_error, p4_found, p4_assign, p4_linked, p4_report, p5_found, p5_report, p6_found, p6_groups, p7_ids, p8_mixture, p8_shares, p9_found)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    split = "case when s in ('valid', 'validation', 'dev') then 'val' when s in ('train', 'val', 'test', 'unseen_test') then s end"

    def narrow(c: str) -> str:
        return f"translate({c}, '{_WIDE}', '{_NARROW}')"

    def plain(c: str) -> str:
        spaced = f"regexp_replace({narrow(c)}, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')"
        return f"regexp_replace(lower(trim({spaced})), '[ _\\-\\x{{2010}}\\x{{2011}}]+', '_', 'g')"

    def number(c: str) -> str:
        return f"regexp_extract({narrow(c)}, '0*([0-9]+)[^0-9]*$', 1)"

    both = f"select {number('template_group')} as g, {plain('split')} as s from handwritten_v0 where template_group is not null union all select {number('id')}, {plain('split')} from groups_clarify"
    return {
        "p4_found": f"select 'TG-' || g as template_group from (select g, {split} as sp from ({both})) where sp is not null and g <> '' group by g having count(distinct sp) > 1",
    }


#: Full-width letters, digits and signs, and their ordinary forms.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94) if chr(0x21 + i) not in "'\\")
_NARROW = "".join(chr(0x21 + i) for i in range(94) if chr(0x21 + i) not in "'\\")
