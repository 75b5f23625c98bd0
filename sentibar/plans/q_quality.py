"""Registered queries: EDA aggregates, dashboard reads, small operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.numeric import clip, ensure_columns, sanitize
from ..operators import app as AP
from ..operators import bars as B
from ..operators import features as FE
from ..operators import pages as PG
from ..operators import quality as QU
from ..operators import sentiment as SE
from ..sources import fixtures as FX
from ..sources.tables import spread
from .catalog import register
from .oracle import cte, q


def news(t):
    return FX.news_from_orders(t.orders)


def bars(t):
    return FX.bars_from_lineitem(t.lineitem)


def features(t):
    return FE.build_features(bars(t), news(t))


_SCORERS = ("finbert_sentiment", "gemma_sentiment_score")

cte("docs", "  SELECT doc_id, lang, source, text, split_part(text, chr(10), 1) AS headline FROM documents")
cte("score_values", "  SELECT asset_tag, scorer, v FROM (" + " UNION ALL ".join(
    f"SELECT asset_tag, '{c}' AS scorer, CAST({c} AS DOUBLE) AS v FROM news "
    "WHERE gemma_sentiment_score IS NOT NULL" for c in _SCORERS) + ") WHERE v IS NOT NULL", "news")


@register("monthly_counts", ops="D9 B25",
          sql="SELECT date_trunc('month', time) AS month, asset_tag, count(*) AS article_count "
              "FROM news GROUP BY 1, 2", ctes=("news",), dates=("month",))
def q_monthly(t):
    return QU.monthly_counts(news(t))


@register("missing_pct", ops="D12",
          sql="""SELECT asset_tag, total, field, missing_pct FROM (
  SELECT asset_tag, count(*) AS total,
         CAST(sum(CASE WHEN summary IS NULL OR summary = '' THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(*) AS summary,
         CAST(sum(CASE WHEN content IS NULL OR content = '' THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(*) AS content
  FROM news GROUP BY asset_tag) UNPIVOT (missing_pct FOR field IN (summary, content))""",
          ctes=("news",), rnd=("missing_pct",), dates=())
def q_missing(t):
    return QU.missing_pct(news(t), ["summary", "content"])


@register("length_histogram", ops="D13 B24",
          sql="""SELECT lang, field, bin, count(*) AS count, pow(10.0, bin / 10.0) AS bin_lo FROM (
  SELECT lang, 'content' AS field, CAST(floor(log10(length(text)) * 10) AS INTEGER) AS bin FROM docs
  WHERE length(text) > 0 AND length(headline) > 0
  UNION ALL
  SELECT lang, 'summary' AS field, CAST(floor(log10(length(headline)) * 10) AS INTEGER) AS bin FROM docs
  WHERE length(text) > 0 AND length(headline) > 0) GROUP BY ALL""",
          ctes=("docs",), rnd=("bin_lo",), dates=())
def q_length_hist(t):
    d = t.documents.select("lang", F.col("text").alias("content"),
                           F.substring_index("text", "\n", 1).alias("summary"))
    return QU.length_histogram(d, ["content", "summary"], "lang")




@register("score_histogram", ops="D14",
          sql="""SELECT asset_tag, scorer, bin, CAST(count(*) AS BIGINT) AS count,
       any_value(lo) + bin * any_value((hi - lo) / 20.0) AS bin_lo FROM (
  SELECT v.asset_tag, v.scorer, r.lo, r.hi,
         CASE WHEN r.hi > r.lo THEN CAST(least(floor((v.v - r.lo) / (r.hi - r.lo) * 20), 19) AS INTEGER)
              ELSE 0 END AS bin
  FROM score_values v JOIN (SELECT asset_tag, scorer, min(v) AS lo, max(v) AS hi FROM score_values
                            GROUP BY ALL) r USING (asset_tag, scorer)) GROUP BY asset_tag, scorer, bin""",
          ctes=("score_values",), rnd=("bin_lo",), dates=())
def q_score_hist(t):
    return QU.fixed_bin_histogram(news(t), "asset_tag", _SCORERS, bins=20,
                                  require="gemma_sentiment_score")


_NORM = repr(1.0 / math.sqrt(2 * math.pi))


def _kde_sql(values: str, group: str) -> str:
    z = "(s.lo + g.g * (s.hi - s.lo) / 199.0 - v.v) / s.h"
    return f"""WITH s AS (SELECT {group}, scorer, CAST(count(v) AS DOUBLE) AS cnt, min(v) AS lo, max(v) AS hi,
    stddev_samp(v) * pow(count(v), -0.2) AS h FROM {values} WHERE v IS NOT NULL GROUP BY ALL)
SELECT v.{group}, v.scorer, g.g AS g, any_value(s.lo + g.g * (s.hi - s.lo) / 199.0) AS x,
       sum(exp(-0.5 * ({z}) * ({z}))) * {_NORM} / (any_value(s.cnt) * any_value(s.h)) AS density
FROM {values} v JOIN s USING ({group}, scorer) CROSS JOIN (SELECT CAST(range AS INTEGER) AS g FROM range(200)) g
WHERE s.h > 0 AND v.v IS NOT NULL GROUP BY v.{group}, v.scorer, g.g"""


@register("score_kde", ops="D15",
          sql=_kde_sql("score_values", "asset_tag"),
          ctes=("score_values",), rnd=("x", "density"), dates=())
def q_score_kde(t):
    return QU.kde_curve(news(t), "asset_tag", _SCORERS, grid=200, require="gemma_sentiment_score")


cte("length_values", """  SELECT lang, 'text' AS scorer, log10(length(text)) AS v FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT lang, 'headline' AS scorer, log10(length(split_part(text, chr(10), 1))) AS v FROM documents
  WHERE length(split_part(text, chr(10), 1)) > 0""")


@register("length_kde", ops="D15 B24",
          sql=_kde_sql("length_values", "lang"),
          ctes=("length_values",), rnd=("x", "density"), dates=())
def q_length_kde(t):
    """Density of the logarithm of text lengths."""
    def log_len(c):
        return F.when(F.length(c) > 0, F.log10(F.length(c).cast("double")))

    d = t.documents.select("lang", log_len(F.col("text")).alias("text"),
                           log_len(F.substring_index("text", "\n", 1)).alias("headline"))
    return QU.kde_curve(d, "lang", ("text", "headline"), grid=200)


@register("impact_summary", ops="D11",
          sql="""SELECT a.asset_tag, c.gemma_impact_type, coalesce(s.count, 0) AS count,
       coalesce(s.avg_sentiment, 0.0) AS avg_sentiment
FROM (SELECT DISTINCT asset_tag FROM news WHERE gemma_impact_type IS NOT NULL) a
CROSS JOIN (VALUES ('Direct'), ('Indirect')) c(gemma_impact_type)
LEFT JOIN (SELECT asset_tag, gemma_impact_type, count(*) AS count, avg(gemma_sentiment_score) AS avg_sentiment
           FROM news WHERE gemma_impact_type IS NOT NULL GROUP BY ALL) s
  USING (asset_tag, gemma_impact_type)""",
          ctes=("news",), rnd=("avg_sentiment",), dates=())
def q_impact_summary(t):
    return SE.impact_summary(news(t))


@register("rolling_30d_sentiment", ops="D10 E7",
          sql="""SELECT trading_session, asset_tag, avg_finbert, avg_gemma,
       avg(avg_finbert) OVER w AS avg_finbert_30d, avg(avg_gemma) OVER w AS avg_gemma_30d
FROM (SELECT trading_session, asset_tag, avg(finbert_sentiment) AS avg_finbert,
             avg(gemma_sentiment_score) AS avg_gemma
      FROM news WHERE gemma_sentiment_score IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY asset_tag ORDER BY trading_session
             RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""",
          ctes=("news",), rnd=("avg_finbert", "avg_gemma", "avg_finbert_30d", "avg_gemma_30d"))
def q_rolling30(t):
    daily = SE.scored_daily_means(news(t))
    return QU.rolling_calendar_mean(daily, ["avg_finbert", "avg_gemma"], days=FV.SMOOTHING_DAYS)


@register("coverage_counts", ops="D16 D17 D18 D19",
          sql="SELECT asset_tag, count(*) AS n_rows, count(finbert_sentiment) AS finbert_sentiment_count, "
              "count(gemma_sentiment_score) AS gemma_sentiment_score_count, "
              "min(trading_session) AS first_session, max(trading_session) AS last_session "
              "FROM news GROUP BY asset_tag",
          ctes=("news",), dates=("first_session", "last_session"))
def q_coverage(t):
    return QU.coverage_counts(news(t))


@register("top_headlines", ops="F2 F3",
          sql="""SELECT * FROM (SELECT asset_tag, trading_session, news_id, headline, gemma_sentiment_score,
       gemma_impact_type, gemma_reasoning,
       row_number() OVER (PARTITION BY asset_tag ORDER BY trading_session DESC, news_id DESC) AS rank
FROM news WHERE gemma_sentiment_score IS NOT NULL) WHERE rank <= 5""",
          ctes=("news",), rnd=("gemma_sentiment_score",))
def q_top_headlines(t):
    top = AP.top_headlines(news(t), 5)
    return top.select("asset_tag", "trading_session", "news_id", "headline", "gemma_sentiment_score",
                      "gemma_impact_type", "gemma_reasoning", F.col("rank").cast("long").alias("rank"))


@register("latest_vs_previous", ops="E13 E14",
          sql="""SELECT asset_tag, trading_session, close, news_volume, gemma_mean, realized_vol_22d,
       news_volume_delta, gemma_mean_delta FROM (
  SELECT asset_tag, trading_session, close, news_volume, gemma_mean, realized_vol_22d,
         coalesce(news_volume - lead(news_volume) OVER w, 0) AS news_volume_delta,
         coalesce(gemma_mean - lead(gemma_mean) OVER w, 0) AS gemma_mean_delta,
         row_number() OVER w AS r
  FROM features WINDOW w AS (PARTITION BY asset_tag ORDER BY trading_session DESC)) WHERE r = 1""",
          ctes=("features",), rnd=("close", "gemma_mean", "realized_vol_22d", "gemma_mean_delta"))
def q_latest(t):
    f = features(t).select("asset_tag", "trading_session", "close", "news_volume", "gemma_mean",
                           "realized_vol_22d")
    return AP.latest_vs_previous(f)


@register("anchored_window", ops="B26",
          sql="""SELECT f.asset_tag, f.trading_session, f.close, f.gemma_mean FROM features f
JOIN (SELECT asset_tag, max(trading_session) AS last FROM features GROUP BY 1) l USING (asset_tag)
WHERE f.trading_session >= l.last - 90""",
          ctes=("features",), rnd=("close", "gemma_mean"))
def q_anchored(t):
    f = features(t).select("asset_tag", "trading_session", "close", "gemma_mean")
    return AP.anchored_window(f, FV.APP_TIME_FRAMES["3 Months"])


@register("card_columns", ops="B29",
          sql="SELECT asset_tag, trading_session, gemma_mean, (gemma_mean + 1) * 50 AS meter, "
              "CAST(floor(gemma_mean * 100 + 0.5) AS BIGINT) AS pct, CASE WHEN gemma_mean > 0 THEN "
              "'positive' WHEN gemma_mean < 0 THEN 'negative' ELSE 'neutral' END AS sign_class FROM daily",
          ctes=("daily",), rnd=("gemma_mean", "meter"))
def q_cards(t):
    d = SE.daily_sentiment(news(t)).select("asset_tag", "trading_session", "gemma_mean")
    return AP.card_columns(d)


@register("asset_scan", ops="A19 F1",
          sql="SELECT asset_tag, trading_session, close, gemma_mean FROM features WHERE asset_tag = 'N'",
          ctes=("features",), rnd=("close", "gemma_mean"))
def q_asset_scan(t):
    f = features(t)
    return (f.filter(F.col("asset_tag") == "N").orderBy("trading_session")
            .select("asset_tag", "trading_session", "close", "gemma_mean"))


@register("headline_preview", ops="B30 F3",
          sql="SELECT time, trading_session, asset_tag, substring(headline, 1, 40) AS headline "
              "FROM news ORDER BY trading_session, news_id LIMIT 100",
          ctes=("news",), dates=("time", "trading_session"))
def q_preview(t):
    return AP.headline_preview(news(t))


@register("rank_categories", ops="F4",
          sql="SELECT gemma_impact_type, count(*) AS total, row_number() OVER "
              "(ORDER BY count(*), gemma_impact_type) AS rank FROM news GROUP BY gemma_impact_type",
          ctes=("news",), dates=())
def q_rank(t):
    r = AP.rank_categories(news(t), "gemma_impact_type")
    return r.withColumn("rank", F.col("rank").cast("long"))


@register("union_series", ops="G1",
          sql="SELECT symbol, trading_session AS date, close FROM bars UNION ALL "
              "SELECT symbol, date, close FROM proxies",
          ctes=("bars", "proxies"), rnd=("close",), dates=("date",))
def q_union(t):
    b = bars(t).select("symbol", F.col("trading_session").alias("date"), "close")
    return b.unionByName(FX.proxies_from_lineitem(t.lineitem))


@register("distinct_links", ops="G2",
          sql=f"""SELECT DISTINCT href FROM (
  SELECT regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM
  (SELECT unnest(regexp_extract_all(html, {q(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>')}, 0)) AS a
   FROM pages)) WHERE length(href) > 0""", dates=())
def q_distinct_links(t):
    return PG.page_links(spread(t.pages)).select("href").distinct()


_NAMES_SQL = "(VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in FX.ASSET_NAMES.items()) + ") m(symbol, name)"


@register("symbol_map", ops="B6 B7 C11",
          sql=f"""SELECT b.symbol, m.name AS asset_tag, CAST(b.time AS DATE) AS trading_session, b.close
FROM (SELECT symbol, time, close FROM bars UNION ALL SELECT symbol, time, close FROM proxy_bars) b
JOIN {_NAMES_SQL} USING (symbol)""",
          ctes=("bars", "proxy_bars"), rnd=("close",))
def q_symbol_map(t):
    allbars = bars(t).unionByName(FX.bars_from_lineitem(t.lineitem, key="l_linestatus"))
    dim = t.spark.createDataFrame(list(FX.ASSET_NAMES.items()), ["symbol", "name"])
    # The dimension is a literal of len(ASSET_NAMES) rows: broadcast is bounded.
    j = allbars.join(F.broadcast(dim), "symbol", "left").filter(F.col("name").isNotNull())
    return j.select("symbol", F.col("name").alias("asset_tag"),
                    F.to_date("time").alias("trading_session"), "close")


@register("null_sanitise", ops="B15 B16 B18",
          sql="SELECT asset_tag, trading_session, realized_vol_22d, vol_roc_1d, log_return_5d, "
              "0.0 AS mean_score_direct FROM features WHERE realized_vol_22d IS NOT NULL AND "
              "vol_roc_1d IS NOT NULL AND log_return_5d IS NOT NULL",
          ctes=("features",), rnd=("realized_vol_22d", "vol_roc_1d", "log_return_5d",
                                   "mean_score_direct"))
def q_null_sanitise(t):
    f = features(t).select("asset_tag", "trading_session", "realized_vol_22d", "vol_roc_1d",
                           "log_return_5d")
    f = ensure_columns(f, ["mean_score_direct"])
    f = sanitize(f, ["realized_vol_22d", "vol_roc_1d", "log_return_5d"])
    return f.dropna(subset=["realized_vol_22d", "vol_roc_1d", "log_return_5d"])


@register("clip_guarded", ops="B14",
          sql="""SELECT asset_tag, trading_session, pred, clipped,
       CASE WHEN clipped IS NOT NULL THEN greatest(least(0.01 / clipped, 2.0), 0.0) END AS position
FROM (SELECT asset_tag, trading_session, pred,
             CASE WHEN pred IS NOT NULL THEN greatest(least(pred, 0.1), 0.005) END AS clipped
      FROM (SELECT asset_tag, trading_session,
                   lag(realized_vol_22d) OVER (PARTITION BY asset_tag ORDER BY trading_session) AS pred
            FROM features))""",
          ctes=("features",), rnd=("pred", "clipped", "position"))
def q_clip(t):
    f = features(t)
    w = B.series_window()
    x = f.select("asset_tag", "trading_session", F.lag("realized_vol_22d").over(w).alias("pred"))
    x = x.withColumn("clipped", clip("pred", *FV.VOL_CLIP))
    return x.withColumn("position", clip(F.lit(FV.TARGET_DAILY_VOL) / F.col("clipped"), *FV.POSITION_CLIP))


@register("date_range_keys", ops="B27 B28 C5",
          sql="""SELECT b.asset_tag, b.trading_session, b.close, p.close AS market_close
FROM bars b JOIN proxies p ON p.symbol = 'O' AND p.date = b.trading_session
WHERE b.trading_session BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""",
          ctes=("bars", "proxies"), rnd=("close", "market_close"))
def q_date_range(t):
    b = bars(t).filter(F.col("trading_session").between(F.lit("1996-01-01").cast("date"),
                                                         F.lit("1996-12-31").cast("date")))
    p = (FX.proxies_from_lineitem(t.lineitem).filter(F.col("symbol") == "O")
         .select(F.col("date").alias("trading_session"), F.col("close").alias("market_close")))
    return b.join(p, "trading_session").select("asset_tag", "trading_session", "close", "market_close")


@register("recent_features_100", ops="E13 A7",
          sql="SELECT asset_tag, trading_session, close, realized_vol_22d FROM (SELECT *, row_number() "
              "OVER (PARTITION BY asset_tag ORDER BY trading_session DESC) AS r FROM features) WHERE r <= 100",
          ctes=("features",), rnd=("close", "realized_vol_22d"))
def q_recent100(t):
    f = features(t).select("asset_tag", "trading_session", "close", "realized_vol_22d")
    return B.top_n_per_group(f, ["asset_tag"], [F.col("trading_session").desc()], 100)


@register("app_histogram", ops="D14 (30 bins, feature table)",
          sql="""SELECT asset_tag, scorer, bin, CAST(count(*) AS BIGINT) AS count,
       any_value(lo) + bin * any_value((hi - lo) / 30.0) AS bin_lo FROM (
  SELECT v.asset_tag, v.scorer, r.lo, r.hi,
         CASE WHEN r.hi > r.lo THEN CAST(least(floor((v.v - r.lo) / (r.hi - r.lo) * 30), 29) AS INTEGER)
              ELSE 0 END AS bin
  FROM (SELECT asset_tag, 'gemma_mean' AS scorer, gemma_mean AS v FROM features WHERE gemma_mean IS NOT NULL) v
  JOIN (SELECT asset_tag, 'gemma_mean' AS scorer, min(gemma_mean) AS lo, max(gemma_mean) AS hi
        FROM features WHERE gemma_mean IS NOT NULL GROUP BY asset_tag) r USING (asset_tag, scorer))
GROUP BY asset_tag, scorer, bin""",
          ctes=("features",), rnd=("bin_lo",), dates=())
def q_app_hist(t):
    """The dashboard's 30-bin distribution of daily mean sentiment per asset."""
    return QU.fixed_bin_histogram(features(t), "asset_tag", ["gemma_mean"], bins=30)


_FRAMES_SQL = " UNION ALL ".join(f"SELECT '{k}' AS time_frame, {v} AS days"
                                 for k, v in FV.APP_TIME_FRAMES.items())


@register("anchored_windows", ops="B26 (all app time frames)",
          sql=f"""SELECT f.asset_tag, f.trading_session, f.close, fr.time_frame
FROM features f
JOIN (SELECT asset_tag, max(trading_session) AS last FROM features GROUP BY 1) l USING (asset_tag)
JOIN ({_FRAMES_SQL}) fr ON f.trading_session >= l.last - fr.days""",
          ctes=("features",), rnd=("close",))
def q_anchored_all(t):
    f = features(t).select("asset_tag", "trading_session", "close")
    return AP.anchored_windows(f, FV.APP_TIME_FRAMES)
