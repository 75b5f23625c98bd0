"""The wide per-(asset, session) feature table.

Plan shape: bars LEFT JOIN daily sentiment on (asset, session), JOIN the
per-asset last-news session (one row per asset), then ONE window pass over
``partitionBy(asset).orderBy(session)`` and a final filter.

The coverage guard keeps, per asset, the prefix of sessions up to the last
news session.  Backward-looking frames are unaffected by cutting a suffix,
and the one forward-looking value (next-day return) is masked when the next
row lies beyond the guard, so every window runs once, before the filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.numeric import log_ratio, safe_div
from .bars import rolling_guarded, series_window
from .sentiment import DAILY_COLS, daily_sentiment, last_news_session, pivot_cols

BAR_COLS = ("time", "symbol", "open", "high", "low", "close", "volume",
            "asset_tag", "trading_session")
PRICE_COLS = ("log_return_1d", "log_return_3d", "log_return_5d",
              "realized_vol_22d", "vol_roc_1d")
DERIVED_COLS = ("sentiment_persistence_3d", "next_day_abs_return")


def feature_columns(types=FV.IMPACT_TYPES):
    return list(BAR_COLS) + list(PRICE_COLS) + list(DAILY_COLS) + \
        pivot_cols(types) + list(DERIVED_COLS)


def build_features(bars: DataFrame, news: DataFrame, asset: str = "asset_tag",
                   session: str = "trading_session", close: str = "close",
                   volume: str = "volume", lags=FV.RETURN_LAGS,
                   vol_window: int = FV.VOL_WINDOW,
                   persistence: int = FV.PERSISTENCE_WINDOW,
                   types=FV.IMPACT_TYPES, drop_warmup: bool = True) -> DataFrame:
    """All 28 feature columns, one row per (asset, session) with a defined
    realized volatility, up to the asset's last news session."""
    daily = daily_sentiment(news, asset=asset, session=session, types=types)
    sent_cols = [c for c in daily.columns if c not in (asset, session)]
    # Last news session per asset: Catalyst prunes this branch to a scan of
    # the two key columns (a small fraction of an article table's bytes,
    # which are dominated by text) with a map-side partial max.
    last = last_news_session(news, asset=asset, session=session)

    joined = (bars.filter(F.col(asset).isNotNull())
              .join(daily, [asset, session], "left")
              .join(last, asset, "inner")            # assets without news vanish
              .fillna(0, subset=sent_cols))

    w = series_window(asset, session)
    r1 = f"log_return_{lags[0]}d"
    prev_v = F.lag(volume, 1).over(w)
    cols = {f"log_return_{n}d": log_ratio(F.col(close), F.lag(close, n).over(w))
            for n in lags}
    feats = joined.withColumns(cols).withColumns({
        f"realized_vol_{vol_window}d": rolling_guarded(F.stddev_samp, r1, w, vol_window),
        "vol_roc_1d": safe_div(F.col(volume) - prev_v, prev_v),
        f"sentiment_persistence_{persistence}d": F.coalesce(
            rolling_guarded(F.avg, "gemma_mean", w, persistence), F.lit(0.0)),
        "next_day_abs_return": F.when(
            F.lead(session, 1).over(w) <= F.col("last_news_session"),
            F.abs(F.lead(r1, 1).over(w))),
    })
    out = feats.filter(F.col(session) <= F.col("last_news_session"))
    if drop_warmup:
        out = out.filter(F.col(f"realized_vol_{vol_window}d").isNotNull())
    names = [c for c in feature_columns(types) if c in out.columns]
    return out.select(*names)


def sentiment_features_joined(bars: DataFrame, news: DataFrame, **kw) -> DataFrame:
    """C1-C3 + E4 + B17 view: the feature table without the price block."""
    f = build_features(bars, news, **kw)
    keep = ["asset_tag", "trading_session", "close"] + list(DAILY_COLS) + \
        ["sentiment_persistence_3d"]
    return f.select(*keep)
