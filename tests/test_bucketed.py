"""Bucketed tables meet without an exchange."""

import datetime as dt

from sentibar.sources import io as IO
from sentibar.sources.io import scratch_path


def test_join_without_exchange(spark):
    rows = [(a, dt.date(2024, 1, d), float(d)) for a in "ABC" for d in range(1, 29)]
    keys = ["asset_tag", "trading_session"]
    tables = []
    for name in ("left_preds", "right_preds"):
        df = spark.createDataFrame(rows, f"asset_tag string, trading_session date, {name} double")
        path = scratch_path(spark, name)
        assert IO.read_bucketed(spark, f"t_{name}", path) is None
        IO.bucketed_table(df, f"t_{name}", path, keys, 4)
        tables.append(IO.read_bucketed(spark, f"t_{name}", path))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = tables[0].join(tables[1], keys, "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.where("left_preds = right_preds").count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
