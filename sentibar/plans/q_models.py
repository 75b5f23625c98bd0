"""Registered queries: strategy evaluation, closed-form statistics and
likelihood models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.numeric import log_ratio
from ..operators import backtest as BT
from ..operators import bars as B
from ..operators import features as FE
from ..operators import keys as K
from ..operators import stats as ST
from ..operators import newton as NW
from ..operators import volmodels as VM
from ..sources import fixtures as FX
from .catalog import register
from .oracle import cte

NAIVE_MODELS = {"Naive Lagged Vol": "naive_lag_vol", "Realized Vol": "realized_vol_22d"}
FACTOR_OF = {"A": "F", "N": "O", "R": "F"}    # N uses a copy of the market: collinear


def features(t):
    return FE.build_features(FX.bars_from_lineitem(t.lineitem), FX.news_from_orders(t.orders))


def naive_predictions(t):
    """Hold-out rows (last 20% per asset) with naive volatility forecasts:
    yesterday's realized volatility, and the realized volatility itself."""
    f = features(t).withColumn("naive_lag_vol",
                               F.lag("realized_vol_22d").over(B.series_window()))
    s = ST.chrono_split(f)
    return s.filter(F.col("split") == "test").select(
        "trading_session", "asset_tag", "close", "log_return_1d", "realized_vol_22d",
        "naive_lag_vol", "gemma_mean", "log_return_5d")


def proxy_returns(t):
    p = FX.proxies_from_lineitem(t.lineitem)
    w = B.series_window("symbol", "date")
    return p.select("symbol", "date", log_ratio(F.col("close"), F.lag("close").over(w))
                    .alias("rm")).filter(F.col("rm").isNotNull())


cte("fsplit", """  SELECT f.*, row_number() OVER (PARTITION BY asset_tag ORDER BY trading_session) AS rn,
         count(*) OVER (PARTITION BY asset_tag) AS cnt,
         lag(realized_vol_22d) OVER (PARTITION BY asset_tag ORDER BY trading_session) AS naive_lag_vol
  FROM features f""", "features")
cte("preds", """  SELECT trading_session, asset_tag, close, log_return_1d, realized_vol_22d, naive_lag_vol,
         gemma_mean, log_return_5d
  FROM fsplit WHERE rn > floor(cnt * 0.8)""", "fsplit")
_LONG = " UNION ALL ".join(
    [f"SELECT asset_tag, trading_session, log_return_1d AS r, '{BT.BUY_AND_HOLD}' AS model, "
     "CAST(NULL AS DOUBLE) AS pred FROM preds"] +
    [f"SELECT asset_tag, trading_session, log_return_1d AS r, '{m}' AS model, {c} AS pred FROM preds"
     for m, c in NAIVE_MODELS.items()])
_WM = "PARTITION BY asset_tag, model ORDER BY trading_session"
cte("curves", f"""  SELECT asset_tag, model, trading_session, r, position, strat_return, equity,
         max(equity) OVER (PARTITION BY asset_tag, model ORDER BY trading_session
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak,
         equity / max(equity) OVER (PARTITION BY asset_tag, model ORDER BY trading_session
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown
  FROM (SELECT *, product(1.0 + strat_return) OVER (PARTITION BY asset_tag, model ORDER BY trading_session
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity
        FROM (SELECT *, CASE WHEN model = '{BT.BUY_AND_HOLD}' THEN r
                        ELSE coalesce(lag(position) OVER ({_WM}) * r, 0.0) END AS strat_return
              FROM (SELECT *, CASE WHEN pred IS NOT NULL
                                   THEN greatest(least(0.01 / greatest(least(pred, 0.1), 0.005), 2.0), 0.0)
                              END AS position
                    FROM ({_LONG}))))""", "preds")
_SQRT252 = repr(math.sqrt(FV.ANNUALISATION))
_SHARPE = (f"CASE WHEN stddev_samp(strat_return) = 0 THEN 0.0 ELSE {_SQRT252} * (avg(strat_return) - 0.0)"
           " / stddev_samp(strat_return) END")


@register("vol_target_backtest", ops="H16 B14 E8 E9 E10 D20",
          sql=f"SELECT asset_tag, model, {_SHARPE} AS sharpe, min(drawdown) AS max_drawdown, "
              "count(*) AS n FROM curves GROUP BY asset_tag, model",
          ctes=("curves",), rnd=("sharpe", "max_drawdown"), dates=())
def q_backtest(t):
    return BT.vol_target_backtest(naive_predictions(t), NAIVE_MODELS)


@register("equity_curve", ops="E8 E10 B14",
          sql="SELECT asset_tag, model, trading_session, position, strat_return, equity FROM curves",
          ctes=("curves",), rnd=("position", "strat_return", "equity"))
def q_equity(t):
    c = BT.equity_curves(BT.to_long(naive_predictions(t), NAIVE_MODELS))
    return c.select("asset_tag", "model", "trading_session", "position", "strat_return", "equity")


@register("drawdown", ops="E9",
          sql="SELECT asset_tag, model, trading_session, peak, drawdown FROM curves",
          ctes=("curves",), rnd=("peak", "drawdown"))
def q_drawdown(t):
    c = BT.equity_curves(BT.to_long(naive_predictions(t), NAIVE_MODELS))
    return c.select("asset_tag", "model", "trading_session", "peak", "drawdown")


@register("sharpe", ops="D20",
          sql=f"SELECT asset_tag, {_SHARPE.replace('strat_return', 'log_return_1d')} AS sharpe "
              "FROM features GROUP BY asset_tag",
          ctes=("features",), rnd=("sharpe",), dates=())
def q_sharpe(t):
    return features(t).groupBy("asset_tag").agg(BT.sharpe(F.col("log_return_1d")).alias("sharpe"))


@register("insight_cone", ops="H17 B19 B20 B21 E13",
          sql="""SELECT asset_tag, trading_session AS latest_date, close AS price, log_return_5d AS expected_return,
       realized_vol_22d AS pred_vol, close * exp(log_return_5d) AS expected_price,
       close * exp(log_return_5d - realized_vol_22d * sqrt(5.0)) AS lower,
       close * exp(log_return_5d + realized_vol_22d * sqrt(5.0)) AS upper,
       CASE WHEN realized_vol_22d > 0.03 THEN 'High Swing/Risk' WHEN realized_vol_22d > 0.015 THEN 'Moderate'
            ELSE 'Low Risk/Stable' END AS regime,
       strftime(trading_session, '%Y-%m-%d') AS latest_date_str,
       printf('%.2f', close) AS price_str, printf('%.2f%%', log_return_5d * 100) AS expected_return_str,
       printf('[%.2f, %.2f]', close * exp(log_return_5d - realized_vol_22d * sqrt(5.0)),
              close * exp(log_return_5d + realized_vol_22d * sqrt(5.0))) AS interval_str
FROM (SELECT *, row_number() OVER (PARTITION BY asset_tag ORDER BY trading_session DESC) AS r FROM features)
WHERE r = 1""",
          ctes=("features",), rnd=("price", "expected_return", "pred_vol", "expected_price",
                                   "lower", "upper"), dates=("latest_date",))
def q_insight(t):
    f = features(t)
    latest = B.top_n_per_group(f, ["asset_tag"], [F.col("trading_session").desc()], 1)
    return BT.insight_rows(latest, mu="log_return_5d", sigma="realized_vol_22d")


@register("plot_series", ops="H20 C4",
          sql="""SELECT f.trading_session, f.asset_tag, f.close, f.gemma_mean, f.realized_vol_22d, p.naive_lag_vol
FROM features f LEFT JOIN preds p USING (trading_session, asset_tag)""",
          ctes=("features", "preds"), rnd=("close", "gemma_mean", "realized_vol_22d", "naive_lag_vol"))
def q_plot_series(t):
    f = features(t).select("trading_session", "asset_tag", "close", "gemma_mean", "realized_vol_22d")
    p = naive_predictions(t).select("trading_session", "asset_tag", "naive_lag_vol")
    return f.join(p, ["trading_session", "asset_tag"], "left")


cte("prx", """  SELECT symbol, date, lr AS rm FROM (
    SELECT symbol, date, CASE WHEN close > 0 AND lag(close) OVER (PARTITION BY symbol ORDER BY date) > 0
                         THEN ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) END AS lr
    FROM proxies) WHERE lr IS NOT NULL""", "proxies")
cte("capm_in", """  SELECT f.asset_tag, f.trading_session, f.log_return_1d AS y, m.rm AS x1,
         CASE f.asset_tag WHEN 'N' THEN m.rm ELSE fa.rm END AS x2
  FROM features f JOIN prx m ON m.symbol = 'O' AND m.date = f.trading_session
  LEFT JOIN prx fa ON fa.symbol = 'F' AND fa.date = f.trading_session
  WHERE f.log_return_1d IS NOT NULL""", "features", "prx")
_LL = "(-n / 2 * ({ln2pi} + ln(({ssr}) / n) + 1))"


def _ll_sql(ssr: str) -> str:
    return _LL.format(ln2pi=repr(ST.LN_2PI), ssr=ssr)


def capm_input(t):
    f = features(t).filter(F.col("log_return_1d").isNotNull())
    # Market and factor from one conditional aggregate per date: the proxies are built once.
    both = proxy_returns(t).groupBy(F.col("date").alias("trading_session")).agg(
        F.max(F.when(F.col("symbol") == "O", F.col("rm"))).alias("x1"),
        F.max(F.when(F.col("symbol") == "F", F.col("rm"))).alias("_xf"))
    j = f.join(both.filter(F.col("x1").isNotNull()), "trading_session")
    copies = [a for a, sym in FACTOR_OF.items() if sym == "O"]      # factor = market copy
    x2 = F.when(F.col("asset_tag").isin(copies), F.col("x1")).otherwise(F.col("_xf"))
    return j.select("asset_tag", "trading_session", F.col("log_return_1d").alias("y"), "x1",
                    x2.alias("x2"))


@register("capm", ops="H1 C5 B28",
          sql=f"""SELECT asset_tag, sxy / sxx AS beta, alpha, CAST(n AS BIGINT) AS n,
       round({_ll_sql('syy - sxy * sxy / sxx')}, 3) AS loglik,
       round(-2 * {_ll_sql('syy - sxy * sxy / sxx')} + 2 * 2.0, 3) AS aic,
       round(-2 * {_ll_sql('syy - sxy * sxy / sxx')} + 2.0 * ln(n), 3) AS bic
FROM (SELECT asset_tag, CAST(regr_count(y, x1) AS DOUBLE) AS n, regr_sxx(y, x1) AS sxx,
             regr_syy(y, x1) AS syy, regr_sxy(y, x1) AS sxy, regr_intercept(y, x1) AS alpha
      FROM capm_in GROUP BY asset_tag)""",
          ctes=("capm_in",), rnd=("beta", "alpha", "loglik", "aic", "bic"), dates=())
def q_capm(t):
    m = ST.market_model(capm_input(t), "y", "x1")
    return m.withColumns({c: F.round(c, 3) for c in ("loglik", "aic", "bic")})


@register("two_factor", ops="H2 C5",
          sql=f"""SELECT asset_tag, b1 AS beta_market, b2 AS beta_factor, collinear, CAST(k AS INTEGER) AS k,
       CAST(n AS BIGINT) AS n, round(ll, 3) AS loglik, round(-2 * ll + 2 * k, 3) AS aic,
       round(-2 * ll + k * ln(n), 3) AS bic FROM (
  SELECT *, {_ll_sql('syy - b1 * s1y - b2 * s2y')} AS ll FROM (
    SELECT *, CASE WHEN collinear THEN s1y / s11 ELSE (s22 * s1y - s12 * s2y) / det END AS b1,
              CASE WHEN collinear THEN 0.0 ELSE (s11 * s2y - s12 * s1y) / det END AS b2,
              CASE WHEN collinear THEN 2.0 ELSE 3.0 END AS k FROM (
      SELECT *, abs(det) <= 1e-10 * s11 * s22 AS collinear FROM (
        SELECT *, s11 * s22 - s12 * s12 AS det FROM (
          SELECT asset_tag, CAST(regr_count(y, x1) AS DOUBLE) AS n, regr_sxx(y, x1) AS s11,
                 regr_sxx(y, x2) AS s22, regr_sxy(x2, x1) AS s12, regr_sxy(y, x1) AS s1y,
                 regr_sxy(y, x2) AS s2y, regr_syy(y, x1) AS syy
          FROM capm_in WHERE x2 IS NOT NULL GROUP BY asset_tag)))))""",
          ctes=("capm_in",), rnd=("beta_market", "beta_factor", "loglik", "aic", "bic"), dates=())
def q_two_factor(t):
    x = capm_input(t).filter(F.col("x2").isNotNull())
    m = ST.two_factor(x, "y", "x1", "x2")
    return m.withColumns({c: F.round(c, 3) for c in ("loglik", "aic", "bic")})


@register("trendline", ops="H18",
          sql="SELECT asset_tag, regr_slope(next_day_abs_return, gemma_dispersion) AS slope, "
              "regr_intercept(next_day_abs_return, gemma_dispersion) AS intercept, "
              "regr_r2(next_day_abs_return, gemma_dispersion) AS r2, "
              "CAST(regr_count(next_day_abs_return, gemma_dispersion) AS BIGINT) AS n FROM features "
              "WHERE gemma_dispersion > 0 AND next_day_abs_return IS NOT NULL GROUP BY asset_tag",
          ctes=("features",), rnd=("slope", "intercept", "r2"), dates=())
def q_trend(t):
    f = features(t).filter((F.col("gemma_dispersion") > 0) & F.col("next_day_abs_return").isNotNull())
    return ST.trend_line(f, "next_day_abs_return", "gemma_dispersion")


@register("chrono_split", ops="E11",
          sql="SELECT asset_tag, trading_session, CASE WHEN rn <= floor(cnt * 0.8) THEN 'train' "
              "ELSE 'test' END AS split FROM fsplit",
          ctes=("fsplit",))
def q_split(t):
    return ST.chrono_split(features(t)).select("asset_tag", "trading_session", "split")


@register("standardize", ops="D22 E11",
          sql="""SELECT s.asset_tag, s.trading_session, s.split,
       (s.realized_vol_22d - m.m1) / CASE WHEN m.s1 = 0 THEN 1.0 ELSE m.s1 END AS realized_vol_22d_z,
       (s.log_return_1d - m.m2) / CASE WHEN m.s2 = 0 THEN 1.0 ELSE m.s2 END AS log_return_1d_z
FROM (SELECT *, CASE WHEN rn <= floor(cnt * 0.8) THEN 'train' ELSE 'test' END AS split FROM fsplit) s
LEFT JOIN (SELECT asset_tag, avg(realized_vol_22d) AS m1, stddev_pop(realized_vol_22d) AS s1,
                  avg(log_return_1d) AS m2, stddev_pop(log_return_1d) AS s2
           FROM fsplit WHERE rn <= floor(cnt * 0.8) GROUP BY asset_tag) m USING (asset_tag)""",
          ctes=("fsplit",), rnd=("realized_vol_22d_z", "log_return_1d_z"))
def q_standardize(t):
    s = ST.chrono_split(features(t))
    z = ST.standardize(s, ["realized_vol_22d", "log_return_1d"])
    return z.select("asset_tag", "trading_session", "split", "realized_vol_22d_z", "log_return_1d_z")


@register("lookback_sequences", ops="E12",
          sql="""SELECT asset_tag, trading_session, y, first_r, last_r, sum_r FROM (
  SELECT asset_tag, trading_session, realized_vol_22d AS y,
         count(*) OVER w AS k, first_value(log_return_1d) OVER w AS first_r,
         last_value(log_return_1d) OVER w AS last_r, sum(log_return_1d) OVER w AS sum_r,
         count(*) OVER (PARTITION BY asset_tag) AS cnt
  FROM features WINDOW w AS (PARTITION BY asset_tag ORDER BY trading_session
                             ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE k = 30 AND cnt >= 40""",
          ctes=("features",), rnd=("y", "first_r", "last_r", "sum_r"))
def q_sequences(t):
    s = ST.lookback_sequences(features(t), ["log_return_1d", "realized_vol_22d"], "realized_vol_22d")
    r = F.transform("seq", lambda x: x["log_return_1d"])
    return s.select("asset_tag", "trading_session", "y", F.element_at(r, 1).alias("first_r"),
                    F.element_at(r, -1).alias("last_r"),
                    F.aggregate(r, F.lit(0.0), lambda a, v: a + v).alias("sum_r"))


@register("naive_vol_metrics", ops="D21",
          sql="SELECT asset_tag, sqrt(avg((naive_lag_vol - realized_vol_22d) * (naive_lag_vol - realized_vol_22d))) "
              "AS rmse, avg(abs(naive_lag_vol - realized_vol_22d)) AS mae, count(*) AS n FROM preds "
              "WHERE naive_lag_vol IS NOT NULL AND realized_vol_22d IS NOT NULL GROUP BY asset_tag",
          ctes=("preds",), rnd=("rmse", "mae"), dates=())
def q_naive_metrics(t):
    return ST.error_metrics(naive_predictions(t), "realized_vol_22d", "naive_lag_vol", ["asset_tag"])


GARCH_FIXED = {"alpha": 0.1, "beta": 0.85}
cte("gresid", """  SELECT asset_tag, trading_session, 100.0 * log_return_1d - avg(100.0 * log_return_1d)
         OVER (PARTITION BY asset_tag) AS e,
         row_number() OVER (PARTITION BY asset_tag ORDER BY trading_session) AS t
  FROM features WHERE log_return_1d IS NOT NULL""", "features")


@register("garch_loglik", ops="H4 (likelihood at fixed parameters)",
          sql=f"""WITH RECURSIVE st AS (SELECT asset_tag, var_samp(e) AS h0, count(*) AS n FROM gresid GROUP BY asset_tag),
r(asset_tag, t, h, e2, ll) AS (
  SELECT g.asset_tag, g.t, st.h0, g.e * g.e, 0.0 + {repr(ST.LN_2PI)} + ln(st.h0) + g.e * g.e / st.h0
  FROM gresid g JOIN st USING (asset_tag) WHERE g.t = 1
  UNION ALL
  SELECT g.asset_tag, g.t, x.h, g.e * g.e, r.ll + {repr(ST.LN_2PI)} + ln(x.h) + g.e * g.e / x.h
  FROM r JOIN gresid g ON g.asset_tag = r.asset_tag AND g.t = r.t + 1
  JOIN st ON st.asset_tag = r.asset_tag,
  LATERAL (SELECT st.h0 * (1 - {GARCH_FIXED['alpha']} - {GARCH_FIXED['beta']}) + {GARCH_FIXED['alpha']} * r.e2
                  + {GARCH_FIXED['beta']} * r.h AS h) x)
SELECT r.asset_tag, st.n, round(-0.5 * arg_max(r.ll, r.t), 3) AS loglik
FROM r JOIN st USING (asset_tag) GROUP BY r.asset_tag, st.n""",
          ctes=("gresid",), rnd=("loglik",), dates=())
def q_garch_loglik(t):
    s = VM.series_arrays(VM.residual_series(features(t)))
    a, b = F.lit(GARCH_FIXED["alpha"]), F.lit(GARCH_FIXED["beta"])
    omega = F.col("h0") * (1 - a - b)
    ll = VM.garch_loglik(F.col("y"), F.col("h0"), omega, a, b)
    return s.select("asset_tag", "n", F.round(ll, 3).alias("loglik"))


def _fold_sql(first: str, step: str, state: str) -> str:
    """A likelihood as a recursive walk over one series: ``state`` columns start
    as ``first`` and move by ``step`` (which sees r.* and g.e)."""
    return f"""WITH RECURSIVE st AS (SELECT asset_tag, var_samp(e) AS h0, count(*) AS n FROM gresid GROUP BY asset_tag),
r(asset_tag, t, {state}, ll) AS (
  SELECT g.asset_tag, g.t, x.*, {repr(ST.LN_2PI)} + ln(x.h) + g.e * g.e / x.h
  FROM gresid g JOIN st USING (asset_tag), LATERAL (SELECT {first}) x WHERE g.t = 1
  UNION ALL
  SELECT g.asset_tag, g.t, x.*, r.ll + {repr(ST.LN_2PI)} + ln(x.h) + g.e * g.e / x.h
  FROM r JOIN gresid g ON g.asset_tag = r.asset_tag AND g.t = r.t + 1
  JOIN st ON st.asset_tag = r.asset_tag, LATERAL (SELECT {step}) x)
SELECT r.asset_tag, st.n, round(-0.5 * arg_max(r.ll, r.t), 3) AS loglik
FROM r JOIN st USING (asset_tag) GROUP BY r.asset_tag, st.n"""


_ROOT = repr(VM.SQRT_2_OVER_PI)


@register("egarch_loglik", ops="H5 (likelihood at fixed parameters)",
          sql=_fold_sql("st.h0 AS h, g.e / sqrt(st.h0) AS z",
                        f"exp(0.05 * ln(st.h0) + 0.1 * (abs(r.z) - {_ROOT}) - 0.05 * r.z + 0.95 * ln(r.h)) AS h, "
                        f"g.e / sqrt(exp(0.05 * ln(st.h0) + 0.1 * (abs(r.z) - {_ROOT}) - 0.05 * r.z + 0.95 * ln(r.h))) AS z",
                        "h, z"),
          ctes=("gresid",), rnd=("loglik",), dates=())
def q_egarch_loglik(t):
    s = VM.series_arrays(VM.residual_series(features(t)))
    ll = VM.egarch_loglik(F.col("y"), F.col("h0"), F.lit(0.05) * F.ln("h0"), F.lit(0.1), F.lit(-0.05), F.lit(0.95))
    return s.select("asset_tag", "n", F.round(ll, 3).alias("loglik"))


_SIG = "0.1 * sqrt(st.h0) + (0.05 + CASE WHEN r.p < 0 THEN 0.1 ELSE 0.0 END) * abs(r.p) + 0.8 * sqrt(r.h)"


@register("tgarch_loglik", ops="H6 (likelihood at fixed parameters)",
          sql=_fold_sql("st.h0 AS h, g.e AS p", f"({_SIG}) * ({_SIG}) AS h, g.e AS p", "h, p"),
          ctes=("gresid",), rnd=("loglik",), dates=())
def q_tgarch_loglik(t):
    s = VM.series_arrays(VM.residual_series(features(t)))
    ll = VM.tgarch_loglik(F.col("y"), F.col("h0"), F.lit(0.1) * F.sqrt("h0"), F.lit(0.05), F.lit(0.1), F.lit(0.8))
    return s.select("asset_tag", "n", F.round(ll, 3).alias("loglik"))


@register("arma_loglik", ops="H3 (likelihood at fixed parameters)",
          sql=f"""WITH RECURSIVE r(asset_tag, t, y, i, s) AS (
  SELECT asset_tag, t, e, e, e * e FROM gresid WHERE t = 1
  UNION ALL
  SELECT g.asset_tag, g.t, g.e, x.i, r.s + x.i * x.i
  FROM r JOIN gresid g ON g.asset_tag = r.asset_tag AND g.t = r.t + 1,
  LATERAL (SELECT g.e - 0.3 * r.y - 0.2 * r.i AS i) x)
SELECT asset_tag, max(t) AS n, round(-max(t) / 2.0 * ({repr(ST.LN_2PI)} + ln(arg_max(s, t) / max(t)) + 1), 3) AS loglik
FROM r GROUP BY asset_tag""",
          ctes=("gresid",), rnd=("loglik",), dates=())
def q_arma_loglik(t):
    s = VM.series_arrays(VM.residual_series(features(t)))
    sse = VM.arma_sse(F.col("y"), F.lit(0.0), F.lit(0.3), F.lit(0.2))
    n = F.col("n").cast("double")
    return s.select("asset_tag", "n", F.round(ST.ols_loglik(n, sse), 3).alias("loglik"))


# One Fisher-scoring step at fixed parameters: omega 0.05 h0, alpha 0.1, beta 0.85.
_GRAD = {"d1": "1 + 0.85 * r.d1", "d2": "r.e * r.e + 0.85 * r.d2", "d3": "r.h + 0.85 * r.d3"}
_TRI = [(i, j) for i in (1, 2, 3) for j in range(1, i + 1)]


def _det(m) -> str:
    return (f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]})-{m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})"
            f"+{m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))")


_INFO = [[f"i{max(a, b)}{min(a, b)}" for b in (1, 2, 3)] for a in (1, 2, 3)]
_CRAMER = [_det([[f"s{a + 1}" if b == k else _INFO[a][b] for b in range(3)] for a in range(3)]) for k in range(3)]


@register("garch_step", ops="H4 (score, information and one step)",
          sql=f"""WITH RECURSIVE st AS (SELECT asset_tag, var_samp(e) AS h0, count(*) AS n FROM gresid GROUP BY asset_tag),
r AS (
  SELECT g.asset_tag, g.t, st.h0 AS h, g.e, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS d2, 0.0::DOUBLE AS d3,
         -0.5 * ({repr(ST.LN_2PI)} + ln(st.h0) + g.e * g.e / st.h0) AS ll,
         {', '.join(f'0.0::DOUBLE AS s{i}' for i in (1, 2, 3))}, {', '.join(f'0.0::DOUBLE AS i{i}{j}' for i, j in _TRI)}
  FROM gresid g JOIN st USING (asset_tag) WHERE g.t = 1
  UNION ALL
  SELECT g.asset_tag, g.t, x.h, g.e, x.d1, x.d2, x.d3,
         r.ll - 0.5 * ({repr(ST.LN_2PI)} + ln(x.h) + g.e * g.e / x.h),
         {', '.join(f'r.s{i} + 0.5 * (g.e * g.e / x.h - 1) * x.d{i} / x.h' for i in (1, 2, 3))},
         {', '.join(f'r.i{i}{j} + 0.5 * x.d{i} * x.d{j} / (x.h * x.h)' for i, j in _TRI)}
  FROM r JOIN gresid g ON g.asset_tag = r.asset_tag AND g.t = r.t + 1 JOIN st ON st.asset_tag = r.asset_tag,
  LATERAL (SELECT 0.05 * st.h0 + 0.1 * r.e * r.e + 0.85 * r.h AS h, {', '.join(f'{v} AS {k}' for k, v in _GRAD.items())}) x)
SELECT r.asset_tag, ll AS loglik, s2 AS score_alpha, s3 AS score_beta,
       0.05 * h0 + {_CRAMER[0]} / {_det(_INFO)} AS omega, 0.1 + {_CRAMER[1]} / {_det(_INFO)} AS alpha,
       0.85 + {_CRAMER[2]} / {_det(_INFO)} AS beta
FROM r JOIN st ON st.asset_tag = r.asset_tag AND st.n = r.t""",
          ctes=("gresid",), rnd=("loglik", "score_alpha", "score_beta", "omega", "alpha", "beta"), dates=())
def q_garch_step(t):
    s = VM.series_arrays(VM.residual_series(features(t)))
    at = F.array(F.col("h0") * 0.05, F.lit(0.1), F.lit(0.85))
    step = s.select("asset_tag", NW.one_step("garch", F.col("y"), F.col("h0"), at).alias("v"))
    return step.select("asset_tag", F.col("v.ll").alias("loglik"), F.get("v.s", F.lit(1)).alias("score_alpha"),
                       F.get("v.s", F.lit(2)).alias("score_beta"),
                       *[F.get("v.to", F.lit(i)).alias(c) for i, c in enumerate(NW.NAMES["garch"])])


def _newton(model):
    def run(t):
        return NW.newton_fit(VM.series_arrays(VM.residual_series(features(t))), model)
    return run


for _model, _op in (("garch", "H4"), ("egarch", "H5"), ("tgarch", "H6")):
    register(f"{_model}_newton", ops=f"{_op} (estimates with standard errors)")(_newton(_model))


@register("arma_exact_loglik", ops="H3 (exact likelihood at fixed parameters)",
          sql=f"""WITH RECURSIVE r AS (
  SELECT asset_tag, t, 0.3 * e + 0.2 * e / x.r AS hat, x.r AS r, e * e / x.r AS ss, ln(x.r) AS lr
  FROM gresid, LATERAL (SELECT (1 + 2 * 0.3 * 0.2 + 0.2 * 0.2) / (1 - 0.3 * 0.3) AS r) x WHERE t = 1
  UNION ALL
  SELECT g.asset_tag, g.t, 0.3 * g.e + 0.2 * (g.e - r.hat) / x.r, x.r, r.ss + (g.e - r.hat) * (g.e - r.hat) / x.r,
         r.lr + ln(x.r)
  FROM r JOIN gresid g ON g.asset_tag = r.asset_tag AND g.t = r.t + 1,
  LATERAL (SELECT 1 + 0.2 * 0.2 - 0.2 * 0.2 / r.r AS r) x)
SELECT asset_tag, max(t) AS n, arg_max(ss, t) / max(t) AS sigma2,
       -0.5 * (max(t) * ({repr(ST.LN_2PI)} + ln(arg_max(ss, t) / max(t)) + 1) + arg_max(lr, t)) AS loglik
FROM r GROUP BY asset_tag""",
          ctes=("gresid",), rnd=("sigma2", "loglik"), dates=())
def q_arma_exact(t):
    s = VM.series_arrays(VM.residual_series(features(t)))
    v = s.select("asset_tag", "n", NW.arma_exact(F.col("y"), F.lit(0.3), F.lit(0.2)).alias("v"))
    return v.select("asset_tag", "n", "v.sigma2", F.col("v.ll").alias("loglik"))


@register("arma_exact_fit", ops="H3 (exact maximum likelihood)")
def q_arma_exact_fit(t):
    return NW.arma_exact_fit(VM.series_arrays(VM.residual_series(features(t))))


@register("persistence_series", ops="H20",
          sql="SELECT trading_session, asset_tag, realized_vol_22d, sentiment_persistence_3d FROM features",
          ctes=("features",), rnd=("realized_vol_22d", "sentiment_persistence_3d"))
def q_persistence_series(t):
    """Volatility against sentiment persistence, per asset and session."""
    return features(t).select("trading_session", "asset_tag", "realized_vol_22d", "sentiment_persistence_3d")


@register("dispersion_series", ops="H20 E5",
          sql="SELECT trading_session, asset_tag, gemma_dispersion, next_day_abs_return FROM features "
              "WHERE gemma_dispersion > 0 AND next_day_abs_return IS NOT NULL",
          ctes=("features",), rnd=("gemma_dispersion", "next_day_abs_return"))
def q_dispersion_series(t):
    """Opinion dispersion against the next day's absolute return."""
    return features(t).select("trading_session", "asset_tag", "gemma_dispersion", "next_day_abs_return").filter(
        (F.col("gemma_dispersion") > 0) & F.col("next_day_abs_return").isNotNull())


@register("residual_writeback", ops="H8 A11 A12",
          sql="SELECT f.asset_tag, f.trading_session, g.e AS garch_residual FROM features f "
              "LEFT JOIN gresid g USING (asset_tag, trading_session)",
          ctes=("features", "gresid"), rnd=("garch_residual",))
def q_writeback(t):
    f = features(t)
    r = VM.residual_series(f).select("asset_tag", "trading_session", F.col("e").alias("garch_residual"))
    out = K.keyed_update(f, r, ["asset_tag", "trading_session"], ["garch_residual"])
    return out.select("asset_tag", "trading_session", "garch_residual")


# ----------------------------------------------------------- rows-only fits
def _fit(t, model: str, scale: float):
    return VM.fit_grid(VM.residual_series(features(t), scale=scale), model)


@register("arma_fit", ops="H3")
def q_arma(t):
    return _fit(t, "arma", 1.0)


@register("garch_fit", ops="H4")
def q_garch(t):
    return _fit(t, "garch", 100.0)


@register("egarch_fit", ops="H5")
def q_egarch(t):
    return _fit(t, "egarch", 100.0)


@register("tgarch_fit", ops="H6")
def q_tgarch(t):
    return _fit(t, "tgarch", 100.0)


@register("garchx_fit", ops="H7")
def q_garchx(t):
    """Mean equation with the sentiment regressors (dispersion, impact index)
    by closed-form OLS, then GARCH(1,1) on its residuals (k = 4 + 2)."""
    f = features(t).filter(F.col("log_return_1d").isNotNull())
    y = (F.col("log_return_1d") * 100).alias("y")
    x = f.select("asset_tag", "trading_session", y, "gemma_dispersion", "article_impact_index")
    coef = ST.two_factor(x, "y", "gemma_dispersion", "article_impact_index").select(
        "asset_tag", "beta_market", "beta_factor")
    means = x.groupBy("asset_tag").agg(F.avg("y").alias("_my"), F.avg("gemma_dispersion").alias("_m1"),
                                       F.avg("article_impact_index").alias("_m2"))
    res = (x.join(coef, "asset_tag").join(means, "asset_tag")
           .select("asset_tag", "trading_session", F.lit(0.0).alias("mu"),
                   ((F.col("y") - F.col("_my"))
                    - F.col("beta_market") * (F.col("gemma_dispersion") - F.col("_m1"))
                    - F.col("beta_factor") * (F.col("article_impact_index") - F.col("_m2"))).alias("e")))
    fit = VM.fit_grid(res, "garch")
    k = 6
    return fit.select("asset_tag", F.lit("garch_x").alias("model"), "alpha", "beta", "level", "loglik",
                      F.lit(k).alias("k"), "n",
                      (-2 * F.col("loglik") + 2 * k).alias("aic"),
                      (-2 * F.col("loglik") + k * F.ln(F.col("n").cast("double"))).alias("bic"))
