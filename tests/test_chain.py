"""Predict, store, evaluate: the strategy step against SQL over stored predictions."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sentibar.plans import q_ml
from sentibar.sources.tables import Tables


def test_strategies_over_stored_predictions(spark):
    got = {(r.asset_tag, r.model): r for r in E.queries()["prediction_backtest"](spark, SF_SMALL).collect()}
    t = Tables(spark, SF_SMALL)
    ml, dl = q_ml.ml_predictions(t).toPandas(), q_ml.dl_predictions(t).toPandas()
    assert {"xgb_pred_baseline", "xgb_pred_finbert", "xgb_pred_gemma", "rf_pred_baseline", "rf_pred_finbert",
            "rf_pred_gemma"} <= set(ml.columns) and len(dl)
    models = {**q_ml.STRATEGIES}
    rows = " UNION ALL ".join(["SELECT asset_tag, trading_session, log_return_1d AS r, 'Buy & Hold' AS model, NULL AS p FROM x"]
                              + [f"SELECT asset_tag, trading_session, log_return_1d, '{m}', {c} FROM x" for m, c in models.items()])
    w = "PARTITION BY asset_tag, model ORDER BY trading_session"
    con = duckdb.connect()
    con.register("ml", ml)
    con.register("dl", dl)
    want = con.execute(f"""WITH x AS (SELECT ml.*, lookback_base_pred, lookback_hybrid_pred
        FROM ml LEFT JOIN dl USING (trading_session, asset_tag)), long AS ({rows}),
      q AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(least(0.01 / greatest(least(p, 0.1), 0.005), 2.0), 0.0) END AS pos FROM long),
      s AS (SELECT *, CASE WHEN model = 'Buy & Hold' THEN r ELSE coalesce(lag(pos) OVER ({w}) * r, 0.0) END AS s FROM q),
      e AS (SELECT *, product(1 + s) OVER ({w} ROWS UNBOUNDED PRECEDING) AS e FROM s),
      d AS (SELECT *, e / max(e) OVER ({w} ROWS UNBOUNDED PRECEDING) - 1 AS d FROM e)
      SELECT asset_tag, model, CASE WHEN stddev_samp(s) = 0 THEN 0 ELSE sqrt(252) * avg(s) / stddev_samp(s) END AS sharpe,
             min(d) AS dd, count(*) AS n FROM d GROUP BY ALL""").fetchall()
    assert len(want) == len(got) == 3 * (1 + len(models))
    for asset, model, sharpe, dd, n in want:
        r = got[(asset, model)]
        assert (r.sharpe, r.max_drawdown, r.n) == (pytest.approx(sharpe, abs=1e-5), pytest.approx(dd, abs=1e-5), n)


def test_metrics_come_from_the_same_table(spark):
    m = E.queries()["feature_set_compare"](spark, SF_SMALL).collect()
    assert len(m) == 3 * 6 and all(r.rmse >= r.mae > 0 for r in m)
