"""Registered queries: model fits (H9-H15, H19) and what follows from them.

Predictions are stored tables, as in the published chain: predict, store,
evaluate.  Model outputs depend on the training library, so these have no SQL
twin; tests hold the evaluation against SQL over the stored predictions.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..operators import backtest as BT
from ..operators import bars as B
from ..operators import features as FE
from ..operators import keys as K
from ..operators import ml as ML
from ..operators import treeshap as TS
from ..operators import recurrent as RC
from ..operators import trend as TR
from ..operators import volmodels as VM
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as FX
from ..sources import io as IO
from .catalog import register


def features(t):
    return FE.build_features(FX.bars_from_lineitem(t.lineitem), FX.news_from_orders(t.orders))


def stored_features(t):
    """The feature table of the model fits: every fit reads it again and again, so
    the bars and the news are rolled up once."""
    return stored_table(t, "features", lambda: features(t))


def with_residual(t):
    f = stored_features(t)
    r = VM.residual_series(f).select("asset_tag", "trading_session", F.col("e").alias("garch_residual"))
    return K.keyed_update(f, r, ["asset_tag", "trading_session"], ["garch_residual"])


def stored_table(t, name: str, build):
    """The named table of this application and data folder: read if an earlier
    query stored it, else built and stored (predict once, evaluate often)."""
    path = _store_path(t, name)
    found = IO.read_optional(t.spark, path)
    return found if found is not None else IO.replace_table(build(), path)


KEY, BUCKETS = ["asset_tag", "trading_session"], 8


def stored_bucketed(t, name: str, build):
    """As ``stored_table``, for prediction tables: bucketed by series and session."""
    path, table = _store_path(t, name), _table_name(t, name)
    found = IO.read_bucketed(t.spark, table, path)
    return found if found is not None else IO.bucketed_table(build(), table, path, KEY, BUCKETS)


def _table_name(t, name: str) -> str:
    return f"sentibar_{hashlib.sha1(_store_path(t, name).encode()).hexdigest()[:12]}_{name}"


def _store_path(t, name: str) -> str:
    root = ensure_checkpoint_dir(t.spark).rstrip("/")
    where = hashlib.sha1(t.sf_dir.encode()).hexdigest()[:12]
    return f"{root}/sentibar-store/{t.spark.sparkContext.applicationId}/{where}/{name}"


def ml_predictions(t):
    """Hold-out rows with the six tree predictions."""
    return stored_bucketed(t, "ml_predictions", lambda: ML.feature_set_compare(stored_features(t))[1])


def dl_predictions(t):
    """Hold-out rows with the base and hybrid look-back predictions."""
    def build():
        key = ["asset_tag", "trading_session"]
        base = ML.lookback_regression(stored_features(t), FV.FEATURES_BASELINE, name="lookback_base")
        hybrid = ML.lookback_regression(with_residual(t), FV.FEATURES_HYBRID, name="lookback_hybrid")
        close = stored_features(t).select(*key, "close")
        return (base.join(hybrid.drop("realized_vol_22d"), key).join(close, key)
                .select("trading_session", "asset_tag", "close", "realized_vol_22d",
                        "lookback_base_pred", "lookback_hybrid_pred"))
    return stored_bucketed(t, "dl_predictions", build)


@register("ml_predictions", ops="H9 H10 H11 A9")
def q_ml_predictions(t):
    return ml_predictions(t)


@register("dl_predictions", ops="H13 H14 A9")
def q_dl_predictions(t):
    return dl_predictions(t)


STRATEGIES = {"XGBoost Baseline": "xgb_pred_baseline", "XGBoost FinBERT": "xgb_pred_finbert",
              "XGBoost Gemma": "xgb_pred_gemma", "RF Baseline": "rf_pred_baseline",
              "RF FinBERT": "rf_pred_finbert", "RF Gemma": "rf_pred_gemma",
              "Look-back Base": "lookback_base_pred", "Look-back Hybrid": "lookback_hybrid_pred"}


def strategy_table(t):
    """C4 + A20: tree predictions with the look-back predictions where that
    table exists; both are bucketed by the join's keys, which meet without an
    exchange."""
    dl_predictions(t)
    root = IO.read_bucketed(t.spark, _table_name(t, "dl_predictions"), _store_path(t, "dl_predictions"))
    preds = ml_predictions(t)
    if root is None:
        return preds
    return preds.join(root.select("trading_session", "asset_tag", "lookback_base_pred", "lookback_hybrid_pred"),
                      KEY, "left")


@register("prediction_backtest", ops="C4 H16 A20 D20 E8 E9")
def q_prediction_backtest(t):
    return BT.vol_target_backtest(strategy_table(t), STRATEGIES)


def _metrics(t, columns: dict):
    preds = ml_predictions(t)
    out = None
    for (variation, label), col in columns.items():
        m = ML.error_metrics(preds, "realized_vol_22d", col, ["asset_tag"]).select(
            "asset_tag", F.lit(variation).alias("variation"), F.lit(label).alias("model"), "rmse", "mae", "n")
        out = m if out is None else out.unionByName(m)
    return out


@register("gbt_metrics", ops="H9 D21 E11")
def q_gbt(t):
    return _metrics(t, {("Gemma", "XGBoost"): "xgb_pred_gemma"})


@register("rf_metrics", ops="H10 D21 E11")
def q_rf(t):
    return _metrics(t, {("Gemma", "RandomForest"): "rf_pred_gemma"})


@register("feature_set_compare", ops="H11 A9")
def q_compare(t):
    return _metrics(t, {(v, m): f"{p}_pred_{v.lower()}" for v in ML.FEATURE_SETS
                        for m, p in (("XGBoost", "xgb"), ("RandomForest", "rf"))}).drop("n")


def attribution_rows(t):
    """Exact attributions of the boosted trees, one row per hold-out row and feature."""
    def build():
        cols = FV.FEATURES_GEMMA
        frame = ML.stored(ML.model_frame(stored_features(t), cols), "attribution-frame")
        _, models = ML.fit_predict(frame, cols, ML.boosted, "xgb_pred_gemma")
        nodes = None
        for a, m in models.items():
            one = TS.ensemble_nodes(t.spark, m).withColumn("asset_tag", F.lit(a))
            nodes = one if nodes is None else nodes.unionByName(one)
        return TS.tree_shapley(frame, nodes, cols)
    return stored_table(t, "attribution", build)


@register("attribution_rows", ops="H12")
def q_attribution_rows(t):
    return attribution_rows(t)


@register("attribution", ops="H12")
def q_attribution(t):
    return ML.attribution_summary(attribution_rows(t))


@register("dependence", ops="H12")
def q_dependence(t):
    """One feature against its attribution (the dependence plot's points)."""
    return attribution_rows(t).filter(F.col("feature") == "gemma_dispersion").select(
        "asset_tag", "trading_session", "value", "shap")


@register("lookback_regression", ops="H13 E12 D22 D21")
def q_lookback(t):
    return ML.error_metrics(dl_predictions(t), "realized_vol_22d", "lookback_base_pred", ["asset_tag"])


@register("hybrid_regression", ops="H14 H8 E12 D22 D21")
def q_hybrid(t):
    return ML.error_metrics(dl_predictions(t), "realized_vol_22d", "lookback_hybrid_pred", ["asset_tag"])


@register("forward_return_model", ops="H15 H17 E6 E13 A20")
def q_forward(t):
    """Boosted trees on the 5-day forward return; the latest row of each
    series is predicted (missing features -> 0) and turned into the insight
    row; volatility comes from the hybrid look-back model, falling back to
    realized volatility where it has no prediction."""
    cols = FV.FEATURES_FORWARD
    f = B.forward_return(stored_features(t), FV.FORWARD_HORIZON)
    latest = B.top_n_per_group(f, ["asset_tag"], [F.col("trading_session").desc()], 1)
    train = (f.dropna(subset=["target_return_5d", *cols])
             .withColumn("split", F.lit("train")))
    score = latest.fillna(0.0, subset=list(cols)).withColumn("split", F.lit("test"))
    frame = train.unionByName(score, allowMissingColumns=True)
    preds, _ = ML.fit_predict(frame, cols, lambda: ML.boosted(step=0.05, depth=4),
                              "expected_return", target="target_return_5d")
    vol = dl_predictions(t).select("asset_tag", "trading_session", "lookback_hybrid_pred")
    row = (latest.join(preds, ["asset_tag", "trading_session"])
           .join(vol, ["asset_tag", "trading_session"], "left")
           .withColumn("sigma", F.coalesce("lookback_hybrid_pred", "realized_vol_22d")))
    return BT.insight_rows(row, mu="expected_return", sigma="sigma")


@register("season_fit", ops="H19",
          sql="""WITH x AS (SELECT asset_tag, CAST(trading_session - DATE '1970-01-01' AS DOUBLE) AS t, close AS y FROM features),
z AS (SELECT asset_tag, count(*) OVER w AS n, t - min(t) OVER w AS t0, t - avg(t) OVER w AS t,
             sin(2 * pi() / 365.25 * t) AS s0, cos(2 * pi() / 365.25 * t) AS c0, y AS y0,
             sin(2 * pi() / 365.25 * t) - avg(sin(2 * pi() / 365.25 * t)) OVER w AS s,
             cos(2 * pi() / 365.25 * t) - avg(cos(2 * pi() / 365.25 * t)) OVER w AS c, y - avg(y) OVER w AS y
      FROM x WINDOW w AS (PARTITION BY asset_tag)),
g AS (SELECT asset_tag, any_value(n) AS n, avg(t0) AS mt, avg(s0) AS ms, avg(c0) AS mc, avg(y0) AS my, sum(t*t) AS tt,
             sum(t*s) AS ts, sum(t*c) AS tc, sum(s*s) AS ss, sum(s*c) AS sc, sum(c*c) AS cc,
             sum(t*y) AS ty, sum(s*y) AS sy, sum(c*y) AS cy, sum(y*y) AS yy FROM z GROUP BY asset_tag),
-- eliminate t, then s
e AS (SELECT *, ss - ts*ts/tt AS ss1, sc - ts*tc/tt AS sc1, cc - tc*tc/tt AS cc1, sy - ts*ty/tt AS sy1, cy - tc*ty/tt AS cy1 FROM g),
b AS (SELECT *, (cy1 - sc1*sy1/ss1) / (cc1 - sc1*sc1/ss1) AS b_c FROM e),
b2 AS (SELECT *, (sy1 - sc1*b_c) / ss1 AS b_s FROM b),
b3 AS (SELECT *, (ty - ts*b_s - tc*b_c) / tt AS b_t FROM b2)
SELECT asset_tag, n, my - b_t*mt - b_s*ms - b_c*mc AS b_one, b_t, b_s, b_c,
       sqrt(greatest(yy - b_t*ty - b_s*sy - b_c*cy, 0.0) / n) AS rmse FROM b3""",
          ctes=("features",), rnd=("b_one", "b_t", "b_s", "b_c", "rmse"), dates=())
def q_season(t):
    return ML.season_fit(features(t))


_HINGES = [f"greatest(t - {0.8 * j / (TR.CHANGEPOINTS + 1)!r}, 0.0)" for j in range(1, TR.CHANGEPOINTS + 1)]
_WAVES = [f"{f}({2 * math.pi * k / 365.25!r} * d)" for k in range(1, TR.PAIRS + 1) for f in ("sin", "cos")]


@register("trend_gram", ops="H19 (normal equations)",
          sql=f"""WITH x AS (SELECT asset_tag, CAST(trading_session - DATE '1970-01-01' AS DOUBLE) AS d, close AS y FROM features
           WHERE close IS NOT NULL),
s AS (SELECT asset_tag, d, y, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS t FROM x WINDOW w AS (PARTITION BY asset_tag)),
z AS (SELECT asset_tag, [1.0, t, {', '.join(_HINGES + _WAVES)}, y] AS z FROM s),
p AS (SELECT asset_tag, z, unnest(range(len(z))) AS i FROM z),
q AS (SELECT asset_tag, z, i, unnest(range(i + 1)) AS j FROM p)
SELECT asset_tag, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       sum(z[i + 1] * z[j + 1]) / sqrt(sum(z[i + 1] * z[i + 1]) * sum(z[j + 1] * z[j + 1])) AS s FROM q GROUP BY ALL""",
          ctes=("features",), rnd=("s",), dates=())
def q_trend_gram(t):
    """Sums of products, each over the roots of the two sums of squares."""
    g = TR.gram(TR.regressors(features(t), "close", "trading_session", "asset_tag"), "asset_tag")
    square = g.where("i = j")
    left = square.select("asset_tag", "i", F.col("s").alias("a"))
    right = square.select("asset_tag", "j", F.col("s").alias("b"))
    return (g.join(left, ["asset_tag", "i"]).join(right, ["asset_tag", "j"])
            .select("asset_tag", "i", "j", (F.col("s") / F.sqrt(F.col("a") * F.col("b"))).alias("s")))


@register("trend_changepoints", ops="H19 (piecewise trend, season)")
def q_trend(t):
    return TR.trend_fit(features(t))


def recurrent_predictions(t):
    """Hold-out rows with the recurrent model on the base and the hybrid features."""
    def build():
        key = ["asset_tag", "trading_session"]
        base = RC.recurrent_regression(stored_features(t), FV.FEATURES_BASELINE, name="recurrent_base")
        hybrid = RC.recurrent_regression(with_residual(t), FV.FEATURES_HYBRID, name="recurrent_hybrid")
        return base.join(hybrid.drop("realized_vol_22d"), key)
    return stored_table(t, "recurrent_predictions", build)


@register("recurrent_predictions", ops="H13 H14 (recurrent)")
def q_recurrent(t):
    return recurrent_predictions(t)


@register("recurrent_metrics", ops="H13 H14 D21")
def q_recurrent_metrics(t):
    out = None
    for label in ("base", "hybrid"):
        m = ML.error_metrics(recurrent_predictions(t), "realized_vol_22d", f"recurrent_{label}_pred", ["asset_tag"])
        m = m.select("asset_tag", F.lit(label).alias("model"), "rmse", "mae", "n")
        out = m if out is None else out.unionByName(m)
    return out
