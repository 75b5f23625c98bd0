"""Daily sentiment roll-ups.

One ``groupBy(asset, session)`` pass computes every daily measure including
the per-impact-type pivot (conditional aggregates instead of a second
group + pivot + join).  All aggregates are algebraic, so Spark combines them
map-side before the shuffle: a day that holds a third of all articles is
reduced to one partial row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV

DAILY_COLS = ("news_volume", "finbert_mean", "gemma_mean", "gemma_dispersion",
              "gemma_conf_weighted", "article_impact_index")


def impact_types(news: DataFrame, impact: str = "gemma_impact_type") -> list[str]:
    """The impact types that occur, lower-cased, in order: one small aggregate
    (a scorer has a handful of types; the driver sees names only)."""
    rows = (news.filter(F.col(impact).isNotNull()).select(F.lower(impact).alias("t"))
            .distinct().orderBy("t").collect())
    return [r.t for r in rows]


def _of_type(impact: str, t: str) -> Column:
    return F.lower(F.col(impact)) == t.lower()


def pivot_cols(types=FV.IMPACT_TYPES):
    return [f"{t.lower()}_{m}" for m in ("mean_score", "impact_index") for t in types]


def _weighted_mean(score: str, conf: str) -> Column:
    # Sum(s*c)/Sum(c) with the denominator over every row that has c, also
    # rows whose score is NULL; 0 when Sum(c) is not positive.
    sc = F.sum(F.col(score) * F.col(conf))
    sconf = F.sum(conf)
    return F.when(sconf > 0, F.coalesce(sc, F.lit(0.0)) / sconf).otherwise(F.lit(0.0))


def daily_sentiment(news: DataFrame, asset="asset_tag", session="trading_session",
                    score="gemma_sentiment_score", conf="gemma_confidence_score",
                    impact="gemma_impact_type", finbert="finbert_sentiment",
                    types=FV.IMPACT_TYPES, with_pivot: bool = True,
                    fill_zero: bool = True) -> DataFrame:
    """D1-D5 (+ D6/D7 pivot) per (asset, session); NULL session/asset dropped.

    Types are matched without regard to case.  The feature table has columns
    for ``FV.IMPACT_TYPES``; ``types=None`` pivots whatever types occur.

    ``fill_zero`` reproduces the pipeline's zero-fill of empty measures.
    """
    types = impact_types(news, impact) if types is None else types
    n = F.count(F.lit(1))
    aggs = [
        n.alias("news_volume"),
        F.avg(finbert).alias("finbert_mean"),
        F.avg(score).alias("gemma_mean"),
        F.stddev_pop(score).alias("gemma_dispersion"),
        _weighted_mean(score, conf).alias("gemma_conf_weighted"),
        (F.avg(score) * F.ln(F.lit(1.0) + n)).alias("article_impact_index"),
    ]
    if with_pivot:
        for t in types:
            s_t = F.when(_of_type(impact, t), F.col(score))
            aggs.append(F.avg(s_t).alias(f"{t.lower()}_mean_score"))
            aggs.append((F.avg(s_t) * F.ln(F.lit(1.0) + F.count(s_t))).alias(f"{t.lower()}_impact_index"))
    out = (news.filter(F.col(session).isNotNull() & F.col(asset).isNotNull())
           .groupBy(asset, session).agg(*aggs))
    if fill_zero:
        cols = [c for c in out.columns if c not in (asset, session, "news_volume")]
        out = out.fillna(0.0, subset=cols)
    return out


def impact_pivot(news: DataFrame, asset="asset_tag", session="trading_session",
                 score="gemma_sentiment_score", impact="gemma_impact_type",
                 types=None) -> DataFrame:
    """D6 + D7 alone: per-type mean and impact index as columns, absent -> 0;
    the types that occur in the data unless ``types`` names them.

    Only (asset, session) groups with at least one typed, scored article
    appear: NULL types are dropped before grouping and a group whose every
    cell would be empty is dropped, as a pivot table does.
    """
    typed = news.filter(F.col(session).isNotNull() & F.col(asset).isNotNull()
                        & F.col(impact).isNotNull())
    aggs = []
    for t in impact_types(news, impact) if types is None else types:
        s_t = F.when(_of_type(impact, t), F.col(score))
        aggs.append(F.coalesce(F.avg(s_t), F.lit(0.0)).alias(f"{t.lower()}_mean_score"))
        aggs.append(F.coalesce(F.avg(s_t) * F.ln(F.lit(1.0) + F.count(s_t)), F.lit(0.0))
                    .alias(f"{t.lower()}_impact_index"))
    return (typed.groupBy(asset, session).agg(*aggs, F.count(score).alias("_n"))
            .filter(F.col("_n") > 0).drop("_n"))


def last_news_session(news: DataFrame, asset="asset_tag",
                      session="trading_session") -> DataFrame:
    """Newest session with news per asset."""
    return (news.filter(F.col(session).isNotNull() & F.col(asset).isNotNull())
            .groupBy(asset).agg(F.max(session).alias("last_news_session")))


def scored_daily_means(news: DataFrame, asset="asset_tag", session="trading_session",
                       score="gemma_sentiment_score", finbert="finbert_sentiment") -> DataFrame:
    """Daily means of both scorers over scored rows only."""
    return (news.filter(F.col(score).isNotNull())
            .groupBy(session, asset)
            .agg(F.avg(finbert).alias("avg_finbert"), F.avg(score).alias("avg_gemma")))


def impact_summary(news: DataFrame, asset="asset_tag", score="gemma_sentiment_score",
                   impact="gemma_impact_type", categories=("Direct", "Indirect")) -> DataFrame:
    """Count and mean per (asset, impact type), re-indexed to a fixed
    category list (absent category -> 0 count and 0 mean)."""
    stats = (news.filter(F.col(impact).isNotNull())
             .groupBy(asset, impact)
             .agg(F.count(F.lit(1)).alias("count"), F.avg(score).alias("avg_sentiment")))
    # Each asset expanded to the fixed category list (len(categories) rows).
    frame = (stats.select(asset).distinct()
             .select(asset, F.explode(F.array(*[F.lit(c) for c in categories])).alias(impact)))
    return (frame.join(stats, [asset, impact], "left")
            .select(asset, impact,
                    F.coalesce("count", F.lit(0)).alias("count"),
                    F.coalesce("avg_sentiment", F.lit(0.0)).alias("avg_sentiment")))
