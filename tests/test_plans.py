"""What the plans look like: filters and columns reach the scans, nothing multiplies rows."""

import os

import pytest

from loomstone import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_multiplies_rows(spark):
    for name, query in plans.queries().items():
        text = plan(query(spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text, name  # no row-at-a-time Python


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(plans.queries()["recent_signals"](spark, DATA))
    assert "GreaterThanOrEqual(captured_at" in text and "IsNotNull(embedding)" in text and "is_deleted" in text
    assert "raw_text" not in text and "redacted_text" not in text
    text = plan(plans.queries()["pricing_summary"](spark, DATA))
    assert "LessThanOrEqual(l_shipdate" in text and "l_tax" not in text and text.count("Exchange") == 1


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(plans.queries()["evidence_top5"](spark, DATA))
    assert text.count("WindowGroupLimit") == 2


def test_the_engine_stands_without_the_subpackage(spark):
    import importlib
    import sys

    saved = {k: v for k, v in sys.modules.items() if k.startswith("loomstone.llm") or k == "__spark_entry__"}
    for k in saved:
        del sys.modules[k]
    sys.modules["loomstone.llm"] = None
    try:
        entry = importlib.import_module("__spark_entry__")
        assert entry.queries().keys() == plans.queries().keys()
    finally:
        del sys.modules["loomstone.llm"]
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(saved)
