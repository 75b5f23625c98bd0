"""Exploratory and data-quality aggregates.

All of them are grouped aggregations with map-side partial aggregation.
Distribution estimates (histograms, kernel densities) first collapse the
input to (group, value) -> count, so their later stages scale with the
number of distinct values, not with the number of articles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly_counts(news: DataFrame, ts: str = "time", asset: str = "asset_tag") -> DataFrame:
    """D9 + B25: articles per (month, asset)."""
    return (news.groupBy(F.date_trunc("month", F.col(ts)).cast("timestamp_ntz").alias("month"), asset)
            .agg(F.count(F.lit(1)).alias("article_count")))


def missing_pct(df: DataFrame, fields, group: str = "asset_tag") -> DataFrame:
    """Share (in %) of NULL-or-empty values per group and field, long form."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for f in fields:
        miss = F.sum(F.when(F.col(f).isNull() | (F.col(f) == ""), 1).otherwise(0))
        aggs.append((miss * 100.0 / F.count(F.lit(1))).alias(f))
    wide = df.groupBy(group).agg(*aggs)
    return wide.unpivot([group, "total"], list(fields), "field", "missing_pct")


def length_histogram(df: DataFrame, text_cols, group: str, bins_per_decade: int = 10) -> DataFrame:
    """D13 + B24: log10-scaled length histogram of several text columns over
    rows where every one of them is non-empty."""
    cond = None
    for c in text_cols:
        x = F.length(F.col(c)) > 0
        cond = x if cond is None else (cond & x)
    stacked = df.filter(cond).select(
        group, F.explode(F.array(*[F.struct(F.lit(c).alias("field"),
                                            F.length(F.col(c)).alias("len"))
                                   for c in text_cols])).alias("_f"))
    b = F.floor(F.log10(F.col("_f.len")) * bins_per_decade).cast("int")
    return (stacked.groupBy(group, F.col("_f.field").alias("field"), b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("bin_lo", F.pow(F.lit(10.0), F.col("bin") / F.lit(float(bins_per_decade)))))


def _long_scores(df: DataFrame, group: str, score_cols) -> DataFrame:
    return df.select(group, F.explode(F.array(*[
        F.struct(F.lit(c).alias("scorer"), F.col(c).cast("double").alias("v"))
        for c in score_cols])).alias("_s")).select(
        group, F.col("_s.scorer").alias("scorer"), F.col("_s.v").alias("v"))


def fixed_bin_histogram(df: DataFrame, group: str, score_cols, bins: int = 20,
                        require: str | None = None) -> DataFrame:
    """Equal-width bins between each (group, scorer) min and max.

    The per-group range is one partial aggregate (a row per group and scorer,
    joined back; AQE broadcasts it when it is small), then bins are counted
    with map-side partial counts: values themselves are never shuffled.
    """
    if require:
        df = df.filter(F.col(require).isNotNull())
    vals = _long_scores(df, group, score_cols).filter(F.col("v").isNotNull())
    rng = vals.groupBy(group, "scorer").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    j = vals.join(rng, [group, "scorer"])
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    idx = F.when(F.col("_hi") > F.col("_lo"),
                 F.least(F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
                                 * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return (j.groupBy(group, "scorer", idx.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"),
                 F.first("_lo").alias("_lo"),
                 F.first(width).alias("_w"))
            .select(group, "scorer", "bin", "count",
                    (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo")))


def kde_curve(df: DataFrame, group: str, score_cols, grid: int = 200, cut: float = 0.0,
              require: str | None = None) -> DataFrame:
    """Gaussian kernel density on a regular grid per (group, scorer).

    Bandwidth by Scott's rule, h = s * n^(-1/5) with the sample standard
    deviation; the grid spans [min - cut*h, max + cut*h].  ``cut`` is 0 as in
    the published plots, whose curve is drawn over a histogram and stops at the
    data range.  Equal values are counted once with their number; every distinct
    value enters the kernel sums as it is, and the sums are partial aggregates
    (a task sends one row per group and grid point).
    """
    if require:
        df = df.filter(F.col(require).isNotNull())
    vals = (_long_scores(df, group, score_cols).filter(F.col("v").isNotNull())
            .groupBy(group, "scorer", "v")
            .agg(F.count(F.lit(1)).alias("_n")))
    # Group statistics: one centred aggregate over the input.
    stats = (_long_scores(df, group, score_cols).groupBy(group, "scorer")
             .agg(F.count("v").cast("double").alias("_cnt"), F.stddev_samp("v").alias("_sd"),
                  F.min("v").alias("_lo"), F.max("v").alias("_hi"))
             .withColumn("_h", F.col("_sd") * F.pow(F.col("_cnt"), F.lit(-0.2)))
             .filter(F.col("_h") > 0))
    j = vals.join(stats, [group, "scorer"])
    start = F.col("_lo") - cut * F.col("_h")
    step = (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")) / F.lit(float(grid - 1))
    g = j.select(group, "scorer", "v", "_n", "_h", "_cnt", start.alias("_x0"), step.alias("_dx"),
                 F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    x = F.col("_x0") + F.col("g") * F.col("_dx")
    z = (x - F.col("v")) / F.col("_h")
    k = F.col("_n") * F.exp(-0.5 * z * z)
    norm = 1.0 / math.sqrt(2 * math.pi)
    return (g.groupBy(group, "scorer", "g")
            .agg(F.first(x).alias("x"),
                 (F.sum(k) * norm / (F.first("_cnt") * F.first("_h"))).alias("density")))


def rolling_calendar_mean(daily: DataFrame, cols, group: str = "asset_tag",
                          day: str = "trading_session", days: int = 30) -> DataFrame:
    """Mean over the trailing ``days`` calendar days (t - days, t], at
    least one observation (pandas ``rolling('30D')``)."""
    w = (Window.partitionBy(group).orderBy(F.unix_date(F.col(day)))
         .rangeBetween(-(days - 1), 0))
    return daily.withColumns({f"{c}_{days}d": F.avg(c).over(w) for c in cols})


def coverage_counts(news: DataFrame, asset: str = "asset_tag", session: str = "trading_session",
                    cols=("finbert_sentiment", "gemma_sentiment_score")) -> DataFrame:
    """Rows, non-null counts per scorer, session extent per asset."""
    return news.groupBy(asset).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(c).alias(f"{c}_count") for c in cols],
        F.min(session).alias("first_session"), F.max(session).alias("last_session"))
