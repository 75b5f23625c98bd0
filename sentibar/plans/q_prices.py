"""Registered queries: bar features and the feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import features as FE
from ..operators import sentiment as SE
from ..sources import fixtures as FX
from .catalog import register
from .oracle import FEATURE_COLS

PX_DOUBLES = ("open", "high", "low", "close", "volume", "log_return_1d",
              "log_return_3d", "log_return_5d", "realized_vol_22d", "vol_roc_1d")
FEATURE_DOUBLES = tuple(c.strip() for c in FEATURE_COLS.split(",")
                        if c.strip() not in ("time", "symbol", "asset_tag",
                                             "trading_session", "news_volume"))
DAILY_DOUBLES = ("finbert_mean", "gemma_mean", "gemma_dispersion",
                 "gemma_conf_weighted", "article_impact_index")
PIVOT_DOUBLES = tuple(SE.pivot_cols())


def bars(t):
    return FX.bars_from_lineitem(t.lineitem)


def news(t):
    return FX.news_from_orders(t.orders)


@register("price_features", ops="E1 E2 E3 B16",
          sql="SELECT asset_tag, trading_session, close, log_return_1d, log_return_3d, "
              "log_return_5d, realized_vol_22d, vol_roc_1d FROM price_features "
              "WHERE realized_vol_22d IS NOT NULL",
          ctes=("price_features",),
          rnd=("close", "log_return_1d", "log_return_3d", "log_return_5d",
               "realized_vol_22d", "vol_roc_1d"))
def q_price_features(t):
    px = B.price_features(bars(t))
    return (px.dropna(subset=["realized_vol_22d"])
            .select("asset_tag", "trading_session", "close", "log_return_1d",
                    "log_return_3d", "log_return_5d", "realized_vol_22d", "vol_roc_1d"))


@register("volume_change", ops="E2",
          sql="SELECT asset_tag, trading_session, volume, vol_roc_1d FROM px_ret",
          ctes=("px_ret",), rnd=("volume", "vol_roc_1d"))
def q_volume_change(t):
    return B.volume_change(bars(t)).select("asset_tag", "trading_session", "volume", "vol_roc_1d")


@register("next_day_abs_return", ops="E5",
          sql="SELECT asset_tag, trading_session, abs(lead(log_return_1d, 1) OVER "
              "(PARTITION BY asset_tag ORDER BY trading_session)) AS next_day_abs_return "
              "FROM px_ret",
          ctes=("px_ret",), rnd=("next_day_abs_return",))
def q_next_day_abs_return(t):
    px = B.price_features(bars(t))
    return B.next_abs_return(px).select("asset_tag", "trading_session", "next_day_abs_return")


@register("forward_return_5d", ops="E6",
          sql="SELECT asset_tag, trading_session, close, CASE WHEN close > 0 AND "
              "lead(close, 5) OVER (PARTITION BY asset_tag ORDER BY trading_session) > 0 "
              "THEN ln(lead(close, 5) OVER (PARTITION BY asset_tag ORDER BY trading_session)"
              " / close) END AS target_return_5d FROM bars",
          ctes=("bars",), rnd=("close", "target_return_5d"))
def q_forward_return(t):
    return B.forward_return(bars(t)).select("asset_tag", "trading_session", "close",
                                            "target_return_5d")


@register("rebased_prices", ops="E15",
          sql="""SELECT a.asset_tag, d.trading_session,
       ff / first_value(ff) OVER (PARTITION BY a.asset_tag ORDER BY d.trading_session) * 100.0 AS rebased
FROM (SELECT DISTINCT trading_session FROM bars) d
CROSS JOIN (SELECT DISTINCT asset_tag FROM bars) a
JOIN LATERAL (SELECT arg_max(close, trading_session) AS ff FROM bars b
              WHERE b.asset_tag = a.asset_tag AND b.trading_session <= d.trading_session) x ON TRUE
WHERE d.trading_session >= (SELECT max(m) FROM (SELECT min(trading_session) AS m FROM bars GROUP BY asset_tag))""",
          ctes=("bars",), rnd=("rebased",))
def q_rebased(t):
    return B.rebased_prices(bars(t))


@register("recent_30", ops="E13",
          sql="SELECT asset_tag, trading_session, close, rn FROM (SELECT asset_tag, trading_session, "
              "close, row_number() OVER (PARTITION BY asset_tag ORDER BY trading_session DESC) AS rn "
              "FROM bars) WHERE rn <= 30",
          ctes=("bars",), rnd=("close",))
def q_recent_30(t):
    b = bars(t).select("asset_tag", "trading_session", "close")
    return B.top_n_per_group(b, ["asset_tag"], [F.col("trading_session").desc()], 30,
                             rank_col="rn").withColumn("rn", F.col("rn").cast("long"))


@register("daily_sentiment", ops="D1 D2 D3 D4 D5 D6 D7 B17",
          sql="SELECT * FROM daily", ctes=("daily",), rnd=DAILY_DOUBLES + PIVOT_DOUBLES)
def q_daily_sentiment(t):
    return SE.daily_sentiment(news(t))


@register("impact_pivot", ops="D6 D7",
          sql="SELECT asset_tag, trading_session, " + ", ".join(
              f"coalesce({c}, 0.0) AS {c}" for c in PIVOT_DOUBLES) +
              " FROM (SELECT asset_tag, trading_session, " + ", ".join(
              f"avg(CASE WHEN gemma_impact_type = '{ty}' THEN gemma_sentiment_score END) AS {ty.lower()}_mean_score, "
              f"avg(CASE WHEN gemma_impact_type = '{ty}' THEN gemma_sentiment_score END) * "
              f"ln(1 + count(CASE WHEN gemma_impact_type = '{ty}' THEN gemma_sentiment_score END)) "
              f"AS {ty.lower()}_impact_index" for ty in ("Direct", "Indirect", "None")) +
              " FROM news WHERE trading_session IS NOT NULL AND asset_tag IS NOT NULL AND "
              "gemma_impact_type IS NOT NULL GROUP BY 1, 2 HAVING count(gemma_sentiment_score) > 0)",
          ctes=("news",), rnd=PIVOT_DOUBLES)
def q_impact_pivot(t):
    return SE.impact_pivot(news(t))


@register("last_news_date", ops="D8", sql="SELECT * FROM last_news", ctes=("last_news",),
          dates=("last_news_session",))
def q_last_news(t):
    return SE.last_news_session(news(t))


@register("sentiment_features_joined", ops="C1 C2 C3 E4 B17",
          sql="SELECT asset_tag, trading_session, close, news_volume, finbert_mean, gemma_mean, "
              "gemma_dispersion, gemma_conf_weighted, article_impact_index, "
              "sentiment_persistence_3d FROM features",
          ctes=("features",),
          rnd=("close",) + DAILY_DOUBLES + ("sentiment_persistence_3d",))
def q_sentiment_joined(t):
    return FE.sentiment_features_joined(bars(t), news(t))


@register("feature_store", ops="C1 C2 C3 E1-E5 D1-D8 B16 B17 A9",
          sql="SELECT * FROM features", ctes=("features",), rnd=FEATURE_DOUBLES,
          dates=("time", "trading_session"))
def q_feature_store(t):
    return FE.build_features(bars(t), news(t))
