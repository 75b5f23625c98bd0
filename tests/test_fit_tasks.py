"""The tasks of a fit follow the rows of its series, not the files of all of them."""

import datetime as dt

import pytest
from pyspark.ml.regression import LinearRegression

from sentibar.operators import ml as ML


@pytest.mark.parametrize("task_rows, want", [(50_000, {1}), (30, {2})])
def test_tasks_of_a_fit(spark, monkeypatch, task_rows, want):
    monkeypatch.setattr(ML, "TASK_ROWS", task_rows, raising=False)
    rows = [(a, dt.date(2020, 1, 1) + dt.timedelta(days=i), "train" if i < 50 else "test", float(i), 2.0 * i)
            for a in "AB" for i in range(60)]
    df = spark.createDataFrame(rows, "asset_tag string, trading_session date, split string, f0 double, y double").repartition(8)
    seen = []

    class Probe(LinearRegression):
        def fit(self, data):
            seen.append((data.rdd.getNumPartitions(), data.count()))
            return super().fit(data)

    preds, models = ML.fit_predict(df, ["f0"], Probe, "p", "y")
    assert list(models) == ["A", "B"] and {n for n, _ in seen} == want and [c for _, c in seen] == [50, 50]
    assert {(r.asset_tag, r.trading_session.day, round(r.p, 6)) for r in preds.collect()} == {
        (a, (dt.date(2020, 1, 1) + dt.timedelta(days=i)).day, 2.0 * i) for a in "AB" for i in range(50, 60)}
