"""Physical plans: no cross products, no Python rows, filters and columns down at the scan."""

import os

import pytest

from auctionlake.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
LAZY = [n for n in CATALOG if not n.startswith(("st", "d1_", "w8", "a11", "d9", "k2", "k3", "run_all", "j1_", "j2_", "j5", "j6", "j12", "d10", "d6"))]


def plan(spark, name):
    return CATALOG[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products_or_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "PythonUDF" not in text and "ArrowEval" not in text and "BatchEvalPython" not in text


def test_scan_reads_what_it_needs(spark):
    text = plan(spark, "a3_by_source")
    assert "o_orderstatus" in text
    assert "o_totalprice" not in text


def test_top_k_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "o1_dashboard")


def test_keep_first_limits_before_the_shuffle(spark):
    text = plan(spark, "w2_keep_first")
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["w5_navigation", "w5_navigation_notices"])
def test_no_task_orders_all_days(spark, name):
    assert "SinglePartition" not in plan(spark, name)


def test_files_are_numbered_in_ranges(spark):
    from pyspark.sql import functions as F

    from auctionlake.plans.jobs import numbered

    rows = spark.range(5000).select(F.concat(F.lit("f"), F.lpad((F.col("id") / 5).cast("int").cast("string"), 5, "0")).alias("file"), (F.col("id") % 5).alias("pos"))
    got = numbered(rows)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["ord"] for r in got.collect()) == list(range(5000))
