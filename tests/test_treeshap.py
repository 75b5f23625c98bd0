"""Leaf-box Shapley values: equal to the sum over all subsets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sentibar.operators import ml as ML
from sentibar.operators import treeshap as TS


def frame(spark, p, n=150, seed=1):
    rng = random.Random(seed)
    rows = []
    for a in ("A", "B"):
        for i in range(n):
            x = [None if rng.random() < 0.02 and i >= n * 0.8 else round(rng.gauss(0, 1), 2) for _ in range(p)]
            y = sum((v or 0.0) * (j + 1) for j, v in enumerate(x[:4])) + ((x[0] or 0) * (x[1] or 0))
            rows.append((a, dt.date(2020, 1, 1) + dt.timedelta(days=i), "train" if i < n * 0.8 else "test", *x, y))
    cols = [f"f{j}" for j in range(p)]
    schema = "asset_tag string, trading_session date, split string, " + ", ".join(f"{c} double" for c in cols) + ", y double"
    return spark.createDataFrame(rows, schema), cols


def fitted(spark, df, cols, factory):
    _, models = ML.fit_predict(df, cols, factory, "p", "y")
    nodes = None
    for a, m in models.items():
        one = TS.ensemble_nodes(spark, m).withColumn("asset_tag", F.lit(a))
        nodes = one if nodes is None else nodes.unionByName(one)
    return models, nodes


@pytest.mark.parametrize("factory", [lambda: ML.boosted(max_iter=4, depth=4), lambda: ML.forest(trees=3, depth=5)])
def test_equals_all_subsets(spark, factory):
    df, cols = frame(spark, 6)
    models, nodes = fitted(spark, df, cols, factory)
    got = {(r.asset_tag, r.trading_session, r.feature): r for r in TS.tree_shapley(df, nodes, cols).collect()}
    assert len(got) == 2 * 30 * 6
    for a, m in models.items():
        for r in ML.shapley_attribution(df, m, cols, a).collect():
            mine = got[a, r.trading_session, r.feature]
            assert mine.shap == pytest.approx(r.shap, abs=1e-9) and mine.value == r.value


def test_thirty_features_add_up(spark):
    df, cols = frame(spark, 30, n=80)
    models, nodes = fitted(spark, df, cols, lambda: ML.boosted(max_iter=3, depth=5))
    shap = TS.tree_shapley(df, nodes, cols).groupBy("asset_tag", "trading_session").agg(F.sum("shap").alias("s")).collect()
    from pyspark.ml.feature import VectorAssembler

    asm = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    for a, m in models.items():
        base = df.where((F.col("split") == "train") & (F.col("asset_tag") == a)).agg(*[F.avg(c).alias(c) for c in cols])
        at_base = m.transform(asm.transform(base)).first().prediction
        rows = m.transform(asm.transform(df.where((F.col("split") == "test") & (F.col("asset_tag") == a)))).collect()
        sums = {r.trading_session: r.s for r in shap if r.asset_tag == a}
        for r in rows:
            assert sums[r.trading_session] == pytest.approx(r.prediction - at_base, abs=1e-9)


def test_without_broadcast(spark):
    df, cols = frame(spark, 3, n=40)
    _, nodes = fitted(spark, df, cols, lambda: ML.boosted(max_iter=2, depth=2))

    def rows(out):
        return sorted((r.asset_tag, r.trading_session, r.feature, round(r.shap, 9)) for r in out.collect())
    assert rows(TS.tree_shapley(df, nodes, cols)) == rows(TS.tree_shapley(df, nodes, cols, max_bytes=0))
