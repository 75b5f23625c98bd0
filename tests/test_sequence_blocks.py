"""Look-back sequences are made in blocks of a series."""

import datetime as dt

from pyspark.sql import functions as F

from sentibar.operators import stats as ST


def series(spark, sizes):
    rows = [(a, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i), float(-i)) for a, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "asset_tag string, trading_session date, v double, y double").repartition(5)


def test_sequences_of_one_series_lie_in_many_tasks(spark):
    df = series(spark, {"A": 4000, "B": 20})
    out = ST.lookback_sequences(df, ["v"], "y", seq_len=30, min_rows=30)
    at = out.withColumn("task", F.spark_partition_id()).select("task", F.size("seq").alias("n")).collect()
    assert len(at) == 3970 and {r.n for r in at} == {30}
    assert len({r.task for r in at}) > 2


def test_sequences_across_block_borders(spark):
    df = series(spark, {"A": 25, "B": 12, "C": 3})
    for block in (1, 4, 5, 1000):
        out = ST.lookback_sequences(df, ["v"], "y", seq_len=4, min_rows=4, keep=["v"], block=block).collect()
        assert len(out) == 21 + 8
        for r in out:
            assert [s.v for s in r.seq] == [r.v - 4, r.v - 3, r.v - 2, r.v - 1] and r.y == -r.v
