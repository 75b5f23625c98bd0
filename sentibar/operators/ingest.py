"""Raw articles to the news table in one lazy plan.

The ingest order of the published pipeline: first non-empty time, tolerant
parse, cutoff, after-close shift by the asset's own market, headline check,
markup removal, first article per (time, headline, asset) wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.text import clean_html, first_nonempty
from ..functions.times import parse_time
from .calendar import shift_by_asset
from .keys import first_wins


def ingest_news(raw: DataFrame, calendar: DataFrame, order, asset: str = "asset_tag",
                us_assets=FV.US_ASSETS, eg_assets=FV.EG_ASSETS, cutoff: str = FV.INGEST_CUTOFF,
                calendar_rows: int | None = None) -> DataFrame:
    """``raw(asset, id, headline, raw_time, summary, content, order...)`` (as
    ``sources.io.normalise_articles`` gives it) -> rows of the news table.
    ``order`` columns say which of several equal articles came first."""
    order = [order] if isinstance(order, str) else list(order)
    timed = raw.withColumn("_t", parse_time("raw_time")).filter(
        (F.col("_t") >= F.lit(cutoff).cast("timestamp_ntz")) & first_nonempty("headline").isNotNull())
    shifted = shift_by_asset(timed, calendar, ts="_t", out="time", asset=asset, us_assets=us_assets,
                             eg_assets=eg_assets, calendar_rows=calendar_rows)
    kept = first_wins(shifted.select("time", F.col("id").alias("news_id"), asset, "headline",
                                     "content", "summary", *order),
                      ["time", "headline", asset], order, keep=["news_id", "content", "summary"])
    # Markup is removed after the dedupe: dropped articles are never parsed.
    return kept.select("time", "news_id", asset, "headline", clean_html("content").alias("content"),
                       clean_html("summary").alias("summary"))
