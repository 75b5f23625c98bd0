"""Trading-calendar alignment of timestamped articles.

C7 is an as-of lookup ("first session whose close is not before the
article").  Instead of a range join it uses a *day table* with one row per
calendar day:

    day, close_ts (when the day is a session), next_session (first session in
    (day, day + search_days])

built by exploding each session over the ``search_days`` days before it and
keeping the minimum per day.  The table is bounded by the calendar length
times (search_days + 1), so it is broadcast and the article side is never
shuffled: alignment is a map-side hash lookup plus one CASE expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from .joins import broadcast_if_bounded


def day_table(calendar: DataFrame, search_days: int = FV.CALENDAR_SEARCH_DAYS,
              calendar_id: str = "calendar_id", session: str = "session_date",
              close: str = "close_ts") -> DataFrame:
    ahead = (calendar
             .select(calendar_id, F.col(session).alias("next_session"),
                     F.explode(F.sequence(F.date_sub(session, search_days),
                                          F.date_sub(session, 1))).alias("day"))
             .groupBy(calendar_id, "day").agg(F.min("next_session").alias("next_session")))
    own = calendar.select(calendar_id, F.col(session).alias("day"), F.col(close).alias("close_ts"))
    return own.join(ahead, [calendar_id, "day"], "full")


def _lookup(articles: DataFrame, days: DataFrame, ts: str, calendar_id: str,
            calendar_col: str | None, known_rows: int | None) -> DataFrame:
    d = broadcast_if_bounded(days, known_rows=known_rows)
    day = F.to_date(F.col(ts))
    if calendar_col is None:
        cond = day == F.col("_cal.day")
    else:
        cond = (day == F.col("_cal.day")) & (F.col(calendar_col) == F.col(f"_cal.{calendar_id}"))
    return articles.alias("_a").join(d.alias("_cal"), cond, "left")


def align_to_sessions(articles: DataFrame, calendar: DataFrame, ts: str = "time",
                      out: str = "trading_session",
                      search_days: int = FV.CALENDAR_SEARCH_DAYS,
                      calendar_id: str = "calendar_id", calendar_col: str | None = None,
                      calendar_rows: int | None = None) -> DataFrame:
    """session = the article's own UTC date when that date is a session
    and the article is not after its close, else the first later session
    within ``search_days``; NULL (unassigned) when there is none.

    ``calendar_col`` names the article column selecting the calendar when the
    calendar table holds several; ``calendar_rows`` (if known on the driver)
    bounds the day table, which is broadcast then.
    """
    days = day_table(calendar, search_days, calendar_id)
    known = calendar_rows * (search_days + 1) if calendar_rows is not None else None
    j = _lookup(articles, days, ts, calendar_id, calendar_col, known)
    t = F.col(f"_a.{ts}")
    session = F.when(F.col("_cal.close_ts").isNotNull() & (t <= F.col("_cal.close_ts")),
                     F.col("_cal.day")).otherwise(F.col("_cal.next_session"))
    return j.select("_a.*", session.alias(out))


def _clock_minutes(t: Column) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def after_close_shift_us(articles: DataFrame, calendar: DataFrame, ts: str = "time",
                         out: str = "shifted_time", close=FV.US_CLOSE, open_=FV.US_OPEN,
                         search_days: int = FV.CALENDAR_SEARCH_DAYS,
                         calendar_id: str = "calendar_id",
                         calendar_rows: int | None = None) -> DataFrame:
    """Clock at/after the close moves to the next session's open; earlier
    clocks (weekends included) are unchanged.  The clock is read as is (the
    published pipeline compares the UTC clock with the local close)."""
    days = day_table(calendar, search_days, calendar_id)
    known = calendar_rows * (search_days + 1) if calendar_rows is not None else None
    j = _lookup(articles, days, ts, calendar_id, None, known)
    t = F.col(f"_a.{ts}")
    nxt = F.col("_cal.next_session")
    opened = F.make_timestamp_ntz(F.year(nxt), F.month(nxt), F.dayofmonth(nxt),
                                  F.lit(open_[0]), F.lit(open_[1]), F.lit(0))
    shifted = F.when(_clock_minutes(t) >= close[0] * 60 + close[1], opened).otherwise(t)
    return j.select("_a.*", shifted.alias(out))


def after_close_shift_eg(articles: DataFrame, ts: str = "time", out: str = "shifted_time",
                         close=FV.EG_CLOSE, open_=FV.EG_OPEN) -> DataFrame:
    """Clock at/after 14:30 moves to the next day, skipping Friday and
    Saturday, at 10:00 (sub-second part kept, as a clock replace does)."""
    t = F.col(ts)
    d1 = F.date_add(F.to_date(t), 1)
    skip = F.when(F.weekday(d1) == 4, 2).when(F.weekday(d1) == 5, 1).otherwise(0)
    delta = F.make_dt_interval(1 + skip, F.lit(open_[0]) - F.hour(t),
                               F.lit(open_[1]) - F.minute(t), -F.second(t).cast("decimal(18,6)"))
    shifted = F.when(_clock_minutes(t) >= close[0] * 60 + close[1], t + delta).otherwise(t)
    return articles.withColumn(out, shifted)


def weekmask_roll(articles: DataFrame, ts: str = "time", out: str = "trading_session") -> DataFrame:
    """Sunday-Thursday week; Friday and Saturday roll to Sunday."""
    d = F.to_date(F.col(ts))
    wd = F.weekday(d)
    return articles.withColumn(out, F.date_add(d, F.when(wd == 4, 2).when(wd == 5, 1).otherwise(0)))


def align_by_asset(articles: DataFrame, calendar: DataFrame, ts: str = "time",
                   out: str = "trading_session", asset: str = "asset_tag",
                   us_assets=FV.US_ASSETS, eg_assets=FV.EG_ASSETS,
                   calendar_rows: int | None = None) -> DataFrame:
    """C7 + C10 in one pass: each article on its own market's calendar (session
    table, or Sunday-Thursday week); other assets stay unassigned."""
    both = weekmask_roll(align_to_sessions(articles, calendar, ts=ts, out="_us", calendar_rows=calendar_rows),
                         ts=ts, out="_eg")
    a = F.col(asset)
    return both.withColumn(out, F.when(a.isin(list(us_assets)), F.col("_us"))
                           .when(a.isin(list(eg_assets)), F.col("_eg"))).drop("_us", "_eg")


def shift_by_asset(articles: DataFrame, calendar: DataFrame, ts: str = "time",
                   out: str = "shifted_time", asset: str = "asset_tag",
                   us_assets=FV.US_ASSETS, eg_assets=FV.EG_ASSETS,
                   calendar_rows: int | None = None) -> DataFrame:
    """C8 + C9 in one pass: the after-close shift of each article's own market;
    other assets keep their time."""
    both = after_close_shift_eg(after_close_shift_us(articles, calendar, ts=ts, out="_us",
                                                     calendar_rows=calendar_rows), ts=ts, out="_eg")
    a = F.col(asset)
    return both.withColumn(out, F.when(a.isin(list(us_assets)), F.col("_us"))
                           .when(a.isin(list(eg_assets)), F.col("_eg")).otherwise(F.col(ts))).drop("_us", "_eg")
