"""Plan guards: no cross products, no row-at-a-time Python, bounded joins."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
PYTHON_FREE = ("feature_store", "daily_sentiment", "session_alignment", "clean_html",
               "lexicon_score", "coalesce_nonempty", "rescore_pending", "llm_reply_json", "vol_target_backtest",
               "capm", "timestamp_rematch", "top_headlines", "score_kde")


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PYTHON_FREE)
def test_no_cross_products_or_python(spark, name):
    plan = _plan(spark, name)
    for op in FORBIDDEN + ("ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert op not in plan, (name, op)


def test_alignment_broadcasts_the_day_table(spark):
    assert "BroadcastHashJoin" in _plan(spark, "session_alignment")


def test_top_headlines_reads_only_its_columns(spark):
    plan = _plan(spark, "top_headlines")
    assert "WindowGroupLimit" in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert scans and all("o_totalprice" not in line for line in scans)


def test_rescoring_shuffles_nothing(spark):
    assert "Exchange" not in _plan(spark, "rescore_pending")
