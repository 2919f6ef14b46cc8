"""Properties of physical plans: what reaches the scan, and joins that must not be there."""

import os

import pytest

from tidewell import plans

DATA = os.environ.get("TIDEWELL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_no_cross_joins(spark, name):
    text = plan(plans.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_range_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    text = plan(plans.queries()["range_scan"](spark, DATA))
    assert "GreaterThanOrEqual(timestamp" in text and "LessThanOrEqual(timestamp" in text
    schema = text[text.index("ReadSchema") :].split("\n")[0]
    assert "vwap" not in schema and "open" not in schema


def test_doubling_takes_one_exchange_per_table(spark):
    from tidewell.operators.rolling import trailing

    dense = spark.createDataFrame([("a", 0, 1, 1.0)], "k string, run int, day int, v double")
    text = plan(trailing(dense, by=["k"], day="day", values=["v"], days=[7, 30]))
    assert text.count("Exchange hashpartitioning") == 1
