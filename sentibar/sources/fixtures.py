"""Mapping of the shared test tables onto the engine's inputs.

* bars     <- lineitem: one OHLCV bar per (l_returnflag, ship date)
* proxies  <- lineitem: same roll-up keyed by l_linestatus (market / factor)
* news     <- orders:   one article per order, with deterministic scores
* calendar <- generated weekday sessions minus fixed holidays
* events   <- events:   intraday article stream (asset = event_type)

Every mapping is a lazy plan over the whole table; the heavy parts are
partial (map-side) aggregations, so a hot key never lands in one task.
The SQL twins of these mappings live in ``sentibar.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import polar_score

# FIXED VALUES: fixture mapping parameters.
NEWS_ASSET = {"F": "A", "O": "N", "P": "R"}
PRIORITY_IMPACT = {"1": "Direct", "2": "Direct", "3": "None", "4": "Indirect", "5": "Indirect"}
FINBERT_LABELS = ("positive", "negative", "neutral")       # by o_orderkey mod 3
CALENDAR_RANGES = (("1994-12-01", "2002-01-31"), ("2023-12-01", "2024-02-29"))
CALENDAR_HOLIDAYS = ("01-01", "07-04", "12-25")
CALENDAR_TZ = "America/New_York"
CALENDAR_CLOSE = (16, 0)
CALENDAR_HALF_DAYS = ("07-03", "12-24")
CALENDAR_HALF_CLOSE = (13, 0)
ASSET_NAMES = {"A": "NVDA", "N": "USO", "R": "EGX"}        # fixture asset -> name


def _bar_order():
    # Total order inside a day: (orderkey, linenumber) repeats, so the price
    # itself ends the key.
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    "l_extendedprice")


def bars_from_lineitem(lineitem: DataFrame, key: str = "l_returnflag") -> DataFrame:
    """Daily OHLCV bars; min_by/max_by are partial aggregates (skew-safe)."""
    order = _bar_order()
    bars = (lineitem
            .groupBy(F.col(key).alias("symbol"),
                     F.to_date("l_shipdate").alias("trading_session"))
            .agg(F.min_by("l_extendedprice", order).alias("open"),
                 F.max("l_extendedprice").alias("high"),
                 F.min("l_extendedprice").alias("low"),
                 F.max_by("l_extendedprice", order).alias("close"),
                 F.sum("l_quantity").alias("volume")))
    return bars.select(
        F.col("trading_session").cast("timestamp_ntz").alias("time"),
        "symbol", "open", "high", "low", "close", "volume",
        F.col("symbol").alias("asset_tag"), "trading_session")


def proxies_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Benchmark series (long form): symbol 'O' = market, 'F' = factor."""
    return bars_from_lineitem(lineitem, key="l_linestatus").select(
        F.col("symbol"), F.col("trading_session").alias("date"), "close")


def _map(col, mapping: dict):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr


def news_from_orders(orders: DataFrame) -> DataFrame:
    """Articles with both scorers' outputs already attached."""
    k = F.col("o_orderkey")
    cust = F.col("o_custkey")
    score = F.when(k % 11 == 0, F.lit(None).cast("double")) \
        .otherwise(((k * 31) % 1999 - 999).cast("double") / F.lit(999.0))
    conf = ((cust * 17) % 97 + 1).cast("double") / F.lit(97.0)
    label = _map(k % 3, {0: FINBERT_LABELS[0], 1: FINBERT_LABELS[1], 2: FINBERT_LABELS[2]})
    prob = ((cust * 13) % 991).cast("double") / F.lit(991.0)
    impact = _map(F.substring("o_orderpriority", 1, 1), PRIORITY_IMPACT)
    raw_time = F.col("o_orderdate") + F.make_dt_interval(
        F.lit(0), F.lit(0), ((k * 37) % 1440).cast("int"))
    return orders.select(
        k.alias("news_id"),
        _map(F.col("o_orderstatus"), NEWS_ASSET).alias("asset_tag"),
        raw_time.alias("time"),
        F.to_date("o_orderdate").alias("trading_session"),
        F.concat(F.lit("Customer "), cust.cast("string"), F.lit(" "),
                 F.col("o_orderpriority")).alias("headline"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .when(k % 5 == 1, F.lit(""))
         .otherwise(F.concat(F.lit("Order "), k.cast("string"),
                             F.lit(" for customer "), cust.cast("string")))
         .alias("summary"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("<p>Order <b>"), k.cast("string"),
                             F.lit("</b> &amp; customer "), cust.cast("string"),
                             F.lit("</p>\n<script>x()</script>")))
         .alias("content"),
        label.alias("finbert_label"),
        prob.alias("finbert_prob"),
        polar_score(label, prob).alias("finbert_sentiment"),
        score.alias("gemma_sentiment_score"),
        conf.alias("gemma_confidence_score"),
        impact.alias("gemma_impact_type"),
        F.concat(F.lit("order "), k.cast("string"), F.lit(" of customer "),
                 cust.cast("string")).alias("gemma_reasoning"),
    )


def reply_text_from_orders(orders: DataFrame) -> DataFrame:
    """Raw scorer replies: JSON inside chatter; truncated when key mod 17 = 0."""
    n = news_from_orders(orders)
    body = F.concat(
        F.lit('{"asset": "'), F.col("asset_tag"),
        F.lit('", "reasoning": "'), F.col("gemma_reasoning"),
        F.lit('", "impact_type": "'), F.col("gemma_impact_type"),
        F.lit('", "sentiment_score": '),
        F.coalesce(F.col("gemma_sentiment_score").cast("string"), F.lit("null")),
        F.lit(', "confidence_score": '), F.col("gemma_confidence_score").cast("string"))
    closing = F.when(F.col("news_id") % 17 == 0, F.lit("")).otherwise(F.lit("}"))
    return n.select("news_id", "asset_tag",
                    F.concat(F.lit("Sure: ```json "), body, closing, F.lit(" ```"))
                    .alias("reply"))


def session_calendar(spark: SparkSession, ranges=CALENDAR_RANGES,
                     holidays=CALENDAR_HOLIDAYS, tz: str = CALENDAR_TZ,
                     close=CALENDAR_CLOSE, calendar_id: str = "US",
                     half_days=CALENDAR_HALF_DAYS, half_close=CALENDAR_HALF_CLOSE) -> DataFrame:
    """Weekday sessions in the given date ranges minus holidays; half days
    close early.

    close_ts is the local close converted to UTC (DST-aware), as a naive
    timestamp.  Size is bounded by the ranges: known on the driver.
    """
    days = None
    for lo, hi in ranges:
        d = spark.range(1).select(F.explode(F.sequence(F.lit(lo).cast("date"),
                                                       F.lit(hi).cast("date"))).alias("d"))
        days = d if days is None else days.unionByName(d)
    half = F.date_format("d", "MM-dd").isin(list(half_days))
    local_close = F.make_timestamp_ntz(
        F.year("d"), F.month("d"), F.dayofmonth("d"),
        F.when(half, half_close[0]).otherwise(close[0]), F.when(half, half_close[1]).otherwise(close[1]), F.lit(0))
    return (days
            .filter((F.weekday("d") < 5) & ~F.date_format("d", "MM-dd").isin(list(holidays)))
            .select(F.lit(calendar_id).alias("calendar_id"),
                    F.col("d").alias("session_date"),
                    F.convert_timezone(F.lit(tz), F.lit("UTC"), local_close).alias("close_ts")))


def calendar_day_count(ranges=CALENDAR_RANGES) -> int:
    """Upper bound of calendar rows, computed on the driver from parameters."""
    from datetime import date
    n = 0
    for lo, hi in ranges:
        n += (date.fromisoformat(hi) - date.fromisoformat(lo)).days + 1
    return n


def events_as_articles(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("news_id"),
                         F.col("event_type").alias("asset_tag"),
                         F.col("ts").alias("time"), "value", "props", "user_id")


def documents_as_articles(documents: DataFrame) -> DataFrame:
    """Documents as articles: headline = first line, content = whole text."""
    first_line = F.substring_index(F.col("text"), "\n", 1)
    return documents.select(
        F.col("doc_id").alias("news_id"), F.col("source").alias("asset_tag"),
        "lang", first_line.alias("headline"),
        F.lit(None).cast("string").alias("summary"),
        F.col("text").alias("content"), "n_chars")
