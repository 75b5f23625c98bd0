"""Series window operators over bars.

A series is one asset; its rows are sessions (one per trading day), so a
partition holds at most a few thousand rows per decade regardless of how
large the raw tick/trade input was.  All window expressions share one
``partitionBy(asset).orderBy(session)`` spec so Catalyst evaluates them in a
single sort and a single Window node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.numeric import log_ratio, safe_div


def series_window(asset: str = "asset_tag", session: str = "trading_session"):
    return Window.partitionBy(asset).orderBy(session)


def rolling_guarded(agg_fn, c: str, w, n: int):
    """Rolling aggregate over the last n rows; NULL until n non-null values
    are in the frame (pandas ``rolling(n)`` with min_periods = n)."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, agg_fn(c).over(frame))


def price_features(bars: DataFrame, asset: str = "asset_tag",
                   session: str = "trading_session", close: str = "close",
                   volume: str = "volume", lags=FV.RETURN_LAGS,
                   vol_window: int = FV.VOL_WINDOW, centered: bool = True) -> DataFrame:
    """E1 log returns, E3 rolling volatility, E2 volume change.

    ``centered=False`` gives sqrt(mean(r^2)) (the documented definition)
    instead of the sample standard deviation the pipeline computes.
    """
    w = series_window(asset, session)
    out = bars.withColumns({
        f"log_return_{n}d": log_ratio(F.col(close), F.lag(close, n).over(w))
        for n in lags})
    r1 = f"log_return_{lags[0]}d"
    if centered:
        vol = rolling_guarded(F.stddev_samp, r1, w, vol_window)
    else:
        frame = w.rowsBetween(-(vol_window - 1), 0)
        vol = F.when(F.count(r1).over(frame) == vol_window,
                     F.sqrt(F.avg(F.col(r1) * F.col(r1)).over(frame)))
    prev_v = F.lag(volume, 1).over(w)
    return out.withColumns({
        f"realized_vol_{vol_window}d": vol,
        "vol_roc_1d": safe_div(F.col(volume) - prev_v, prev_v),
    })


def volume_change(bars: DataFrame, asset="asset_tag", session="trading_session",
                  volume="volume") -> DataFrame:
    """E2 alone: (v - v_prev) / v_prev, NULL on a zero previous volume."""
    w = series_window(asset, session)
    prev_v = F.lag(volume, 1).over(w)
    return bars.withColumn("vol_roc_1d", safe_div(F.col(volume) - prev_v, prev_v))


def next_abs_return(df: DataFrame, asset="asset_tag", session="trading_session",
                    ret="log_return_1d", name="next_day_abs_return") -> DataFrame:
    """E5: |r| of the next row of the same series."""
    return df.withColumn(name, F.abs(F.lead(ret, 1).over(series_window(asset, session))))


def forward_return(df: DataFrame, horizon: int = FV.FORWARD_HORIZON, asset="asset_tag",
                   session="trading_session", close="close",
                   name: str | None = None) -> DataFrame:
    """ln(close[t+h] / close[t])."""
    w = series_window(asset, session)
    return df.withColumn(name or f"target_return_{horizon}d",
                         log_ratio(F.lead(close, horizon).over(w), F.col(close)))


def rebased_prices(bars: DataFrame, asset="asset_tag", session="trading_session",
                   close="close", base: float = 100.0) -> DataFrame:
    """Closes forward-filled on the union of all dates, dates before the
    last series starts dropped, each series rebased to ``base`` on the first
    kept date.  Long output (session, asset, rebased).

    Forward fill without a dates x assets grid: every bar is expanded over
    the calendar days up to the day before its successor (bounded by the gap
    length) and semi-joined with the set of observed dates.
    """
    w = Window.partitionBy(asset).orderBy(session)
    t_max = bars.agg(F.max(session)).scalar()
    t0 = (bars.filter(F.col(close).isNotNull()).groupBy(asset)
          .agg(F.min(session).alias("_m")).agg(F.max("_m")).scalar())
    # A session without a close carries the previous one forward.
    known = bars.filter(F.col(close).isNotNull())
    seg = known.select(asset, F.col(session).alias("_s"), close,
                      F.coalesce(F.date_sub(F.lead(session).over(w), 1), t_max).alias("_e"))
    filled = seg.select(asset, F.explode(F.sequence("_s", "_e")).alias(session), close)
    dates = bars.select(session).distinct()
    kept = filled.join(dates, session, "left_semi").filter(F.col(session) >= t0)
    first = F.first(close).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return kept.select(asset, session, (F.col(close) / first * F.lit(base)).alias("rebased"))


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int,
                    rank_col: str | None = None) -> DataFrame:
    """Top-n rows per group by ``order_cols`` (Column expressions).

    A rank filter over one window: Spark plants a group limit below the
    exchange, so each task sends at most ``n`` rows of a group and a hot group
    is never sorted whole in one task.  Ties must be broken by ``order_cols``
    for a stable result."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    name = rank_col or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)
