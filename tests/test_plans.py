"""Physical plans: filters and columns reach the scan, joins have keys, Python stays out where it isn't needed."""

import os
import re

import pytest

from quillmere.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

#: Queries that call Python by design: the decimal calculator, canonical JSON, the stateful stream.
PYTHON = {"t3_calculate", "f10_same_value", "st2_pending_stream"}
#: Queries whose small side is a parameter or a table of fixed size: search terms, probes, parts of templates, one-row totals.
LOOPS = {"t1_search_batch", "j10_contains_join", "generate_product", "v28_targets"}
#: Queries that run on the way, so their last plan says little.
STAGED = {"st1_stream_dedup", "st2_pending_stream", "io_json_lines", "io_resumable_append"}


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(spark, "t4_agg_filtered")
    scan = next(line for line in text.splitlines() if "FileScan" in line and "o_orderdate" in line)
    for wanted in ("GreaterThanOrEqual(o_orderdate", "LessThanOrEqual(o_orderdate", "In(o_orderstatus"):
        assert wanted in scan
    assert set(re.findall(r"o_\w+(?=:)", scan.partition("ReadSchema: ")[2])) == {"o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"}
    assert "In(r_name" in text


def test_overlaps_join_on_keys(spark):
    for name in ("t5_availability", "t5_overlap_pairs", "t6_create_event"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert "_bucket" in text


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - STAGED))
def test_no_loops_and_no_python(spark, name):
    text = plan(spark, name)
    if name not in LOOPS:
        assert "CartesianProduct" not in text and "NestedLoop" not in text
    if name not in PYTHON:
        assert not re.search(r"Python|Pandas|Arrow", text)
