"""Dashboard-facing queries.

Per-asset "latest" and "top" selections use the two-phase salted top-n of
``operators.bars`` (hot assets are never ranked in one task); anchored
look-back windows join a per-asset max aggregate instead of a window over
the whole asset partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import top_n_per_group


def top_headlines(news: DataFrame, n: int = 5, asset: str = "asset_tag",
                  session: str = "trading_session", key: str = "news_id",
                  score: str = "gemma_sentiment_score") -> DataFrame:
    """F2: the n most recent scored articles per asset (ties by key, newest
    id first, so the result is deterministic)."""
    scored = news.filter(F.col(score).isNotNull())
    return top_n_per_group(scored, [asset], [F.col(session).desc(), F.col(key).desc()], n,
                           rank_col="rank")


def latest_vs_previous(features: DataFrame, asset: str = "asset_tag",
                       session: str = "trading_session",
                       cols=("news_volume", "gemma_mean")) -> DataFrame:
    """Newest row per asset with deltas against the previous row
    (delta 0 when the asset has a single row)."""
    top2 = top_n_per_group(features, [asset], [F.col(session).desc()], 2, rank_col="_r")
    w = Window.partitionBy(asset).orderBy(F.col("_r"))
    out = top2.withColumns({f"{c}_delta": F.coalesce(F.col(c) - F.lead(c, 1).over(w), F.lit(0))
                            for c in cols})
    return out.filter(F.col("_r") == 1).drop("_r")


def anchored_window(df: DataFrame, days: int, asset: str = "asset_tag",
                    session: str = "trading_session") -> DataFrame:
    """Rows within ``days`` of the asset's newest session (anchored on
    the data, not on today)."""
    last = df.groupBy(asset).agg(F.max(session).alias("_last"))
    return (df.join(last, asset)
            .filter(F.col(session) >= F.date_sub(F.col("_last"), days))
            .drop("_last"))


def anchored_windows(df: DataFrame, frames: dict, asset: str = "asset_tag",
                     session: str = "trading_session") -> DataFrame:
    """B26 for several time frames at once: each asset's newest session is
    expanded to one row per frame (len(frames) rows per asset) and joined
    back, so the input is scanned once for all frames."""
    last = df.groupBy(asset).agg(F.max(session).alias("_last"))
    fr = F.explode(F.array(*[F.struct(F.lit(k).alias("time_frame"), F.lit(v).alias("_days"))
                             for k, v in frames.items()]))
    bounds = last.select(asset, "_last", fr.alias("_f")).select(
        asset, F.col("_f.time_frame").alias("time_frame"),
        F.date_sub(F.col("_last"), F.col("_f._days")).alias("_from"))
    return (df.join(bounds, asset).filter(F.col(session) >= F.col("_from")).drop("_from"))


def card_columns(df: DataFrame, score: str = "gemma_mean") -> DataFrame:
    """Meter position (score+1)*50, whole percent (round half up),
    sign class."""
    s = F.col(score)
    return df.withColumns({
        "meter": (s + 1) * 50,
        "pct": F.floor(s * 100 + 0.5).cast("long"),
        "sign_class": F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral"),
    })


def headline_preview(news: DataFrame, n: int = 100, width: int = 40,
                     order=("trading_session", "news_id")) -> DataFrame:
    """The first ``n`` rows in a fixed order with a short headline.
    The limit is the feature (a preview); the order makes it deterministic."""
    return (news.orderBy(*order).limit(n)
            .select("time", "trading_session", "asset_tag",
                    F.substring("headline", 1, width).alias("headline")))


def rank_categories(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    """categories ordered ascending by total (count when no value)."""
    tot = F.sum(value) if value else F.count(F.lit(1))
    agg = df.groupBy(category).agg(tot.alias("total"))
    # One row per category: a bounded, tiny input to the ordering window.
    return agg.withColumn("rank", F.row_number().over(Window.orderBy("total", category)))
