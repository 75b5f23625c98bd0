"""Leaves of bounded ensembles go to the tasks; rows are not multiplied by them."""

import datetime as dt

from sentibar.operators import treeshap as TS


def test_rows_do_not_meet_leaves_in_a_join(spark):
    """Bounded ensembles: one row per test row and feature, none per leaf."""
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), "train" if i < 8 else "test", float(i), None if i == 9 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "asset_tag string, trading_session date, split string, f0 double, f1 double")
    nodes = spark.createDataFrame([("A", 0, 0, 1, 2, 0, 5.0, 0.0), ("A", 0, 1, -1, -1, -1, 0.0, 10.0), ("A", 0, 2, -1, -1, -1, 0.0, 20.0)],
                                  "asset_tag string, tree int, node int, left int, right int, feature int, threshold double, value double")
    out = TS.tree_shapley(df, nodes, ["f0", "f1"])
    got = {(r.trading_session.day, r.feature): (r.value, r.shap) for r in out.collect()}
    assert got == {(9, "f0"): (8.0, 10.0), (9, "f1"): (1.0, 0.0), (10, "f0"): (9.0, 10.0), (10, "f1"): (None, 0.0)}
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
