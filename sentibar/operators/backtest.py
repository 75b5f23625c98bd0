"""Volatility-targeting evaluation.

Prediction columns are unpivoted to long form (asset, model, session, ...)
so every model shares one ``partitionBy(asset, model).orderBy(session)``
window: position, lagged strategy return, running equity (product), running
peak and drawdown are computed in one window pass, the per-series metrics
in one grouped aggregate.  Buy-and-hold is the model whose strategy return
is the asset return itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.numeric import clip

BUY_AND_HOLD = "Buy & Hold"


def to_long(preds: DataFrame, models: dict, asset: str = "asset_tag",
            session: str = "trading_session", ret: str = "log_return_1d",
            include_buy_hold: bool = True) -> DataFrame:
    """(asset, session, ret, model, pred) rows; ``models`` maps display name
    -> prediction column (absent columns are skipped)."""
    items = [(name, c) for name, c in models.items() if c in preds.columns]
    structs = [F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("pred"))
               for name, c in items]
    if include_buy_hold:
        structs.insert(0, F.struct(F.lit(BUY_AND_HOLD).alias("model"),
                                   F.lit(None).cast("double").alias("pred")))
    return preds.select(asset, session, ret, F.explode(F.array(*structs)).alias("_m")).select(
        asset, session, ret, F.col("_m.model").alias("model"), F.col("_m.pred").alias("pred"))


def equity_curves(long: DataFrame, asset: str = "asset_tag", session: str = "trading_session",
                  ret: str = "log_return_1d", target_vol: float = FV.TARGET_DAILY_VOL,
                  vol_clip=FV.VOL_CLIP, pos_clip=FV.POSITION_CLIP) -> DataFrame:
    """E8-E10 + B14: per (asset, model, session) position, strategy return,
    equity (running product of 1 + r, compounding log returns as simple, as
    the published evaluation does), running peak and drawdown."""
    w = Window.partitionBy(asset, "model").orderBy(session)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    pos = clip(F.lit(target_vol) / clip("pred", *vol_clip), *pos_clip)
    strat = F.when(F.col("model") == BUY_AND_HOLD, F.col(ret)) \
        .otherwise(F.coalesce(F.lag("position", 1).over(w) * F.col(ret), F.lit(0.0)))
    out = (long.withColumn("position", pos)
           .withColumn("strat_return", strat)
           .withColumn("equity", F.product(F.lit(1.0) + F.col("strat_return")).over(run)))
    return (out.withColumn("peak", F.max("equity").over(run))
            .withColumn("drawdown", F.col("equity") / F.col("peak") - 1))


def sharpe(r: Column, rf: float = 0.0, periods: int = FV.ANNUALISATION) -> Column:
    """sqrt(periods) * (mean - rf) / sample std; 0 when std is 0."""
    sd = F.stddev_samp(r)
    return F.when(sd == 0, F.lit(0.0)).otherwise(
        F.lit(math.sqrt(periods)) * (F.avg(r) - F.lit(rf)) / sd)


def strategy_metrics(curves: DataFrame, asset: str = "asset_tag") -> DataFrame:
    """Sharpe and maximum drawdown per (asset, model)."""
    return curves.groupBy(asset, "model").agg(
        sharpe(F.col("strat_return")).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.count(F.lit(1)).alias("n"))


def vol_target_backtest(preds: DataFrame, models: dict, **kw) -> DataFrame:
    return strategy_metrics(equity_curves(to_long(preds, models), **kw))


def regime(vol: Column, thresholds=FV.REGIME_THRESHOLDS, labels=FV.REGIME_LABELS) -> Column:
    """Volatility regime label."""
    return (F.when(vol > thresholds[1], labels[2])
            .when(vol > thresholds[0], labels[1])
            .otherwise(labels[0]))


def insight_rows(latest: DataFrame, mu: str, sigma: str, price: str = "close",
                 session: str = "trading_session", horizon: int = FV.FORWARD_HORIZON) -> DataFrame:
    """Price cone exp(mu +- sigma*sqrt(h)), regime and the
    formatted report strings, one row per input row (the latest per asset)."""
    s_h = F.col(sigma) * F.lit(math.sqrt(horizon))
    p = F.col(price)
    lo = p * F.exp(F.col(mu) - s_h)
    hi = p * F.exp(F.col(mu) + s_h)
    return latest.select(
        "asset_tag", F.col(session).alias("latest_date"), p.alias("price"),
        F.col(mu).alias("expected_return"), F.col(sigma).alias("pred_vol"),
        (p * F.exp(F.col(mu))).alias("expected_price"), lo.alias("lower"), hi.alias("upper"),
        regime(F.col(sigma)).alias("regime"),
        F.date_format(session, "yyyy-MM-dd").alias("latest_date_str"),
        F.format_string("%.2f", p).alias("price_str"),
        F.format_string("%.2f%%", F.col(mu) * 100).alias("expected_return_str"),
        F.format_string("[%.2f, %.2f]", lo, hi).alias("interval_str"))
