"""Tolerant timestamp parsing (B2) with built-in expressions.

A text may be an ISO instant, a slash or dotted date, or a date with a month
name, each with or without a clock, seconds, fraction, AM/PM and zone.  An
English weekday in front is dropped.  Without a zone the text is read as UTC;
the result is the naive UTC timestamp.  What matches no form gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_

#: Optional sections: the form that takes the whole text counts.  A slash date
#: of three short numbers is month first.
DATES = ("[yyyy-M-d][yyyy/M/d][yyyy.M.d][M/d/yyyy][d.M.yyyy]"
         "[MMMM d yyyy][MMM d yyyy][d MMMM yyyy][d MMM yyyy][d-MMM-yyyy]")
WEEKDAY = r"(?i)^(mon|tues?|wed(nes)?|thur?s?|fri|sat(ur)?|sun)(day)?\.?,?\s+"
ZONE = r"(?i)\s*(Z|UTC|GMT|UT|[+-][0-9]{2}:?[0-9]{2})$"
CLOCK = r"(?i)[\sT,]+(?:at\s+)?([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]{1,6})?)[0-9]*)?(?:\s*([ap])\.?m\.?)?$"


def bind(x: Column, fn) -> Column:
    """``fn(x)`` with ``x`` evaluated once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def parse_time(c) -> Column:
    """Naive UTC timestamp of a text in any of the known forms, else NULL."""

    def stamp(date: Column, clock: Column, zone: Column) -> Column:
        half = F.lower(clock[3])
        hour = F.coalesce(clock[0].try_cast("int"), F.lit(0))
        hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
        minute = F.coalesce(clock[1].try_cast("int"), F.lit(0))
        second = F.coalesce(clock[2].try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
        ahead = F.when(F.length(zone) == 5, F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (
            F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int"))).otherwise(0)
        dashed = F.regexp_replace(date, "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
        day = F.try_to_timestamp(F.nullif(dashed, F.lit("")), F.lit(DATES)).cast("timestamp_ntz")
        return bind(F.struct(hour.alias("h"), minute.alias("m"), second.alias("s")), lambda x: F.when(
            (x["h"] < 24) & (x["m"] < 60) & (x["s"] < 60),
            day + F.make_dt_interval(F.lit(0), x["h"], x["m"] - ahead, x["s"])))

    def parts(raw: Column) -> Column:
        zone = F.regexp_replace(F.regexp_extract(raw, ZONE, 1), "[^0-9+-]", "")
        body = F.when(raw.rlike(r"[0-9]:[0-9]{2}"), F.regexp_replace(raw, ZONE, "")).otherwise(raw)
        split = bind(body, lambda b: F.struct(
            F.trim(F.regexp_replace(F.regexp_replace(b, CLOCK, ""), r"[,\s]+", " ")).alias("date"),
            F.array(*[F.regexp_extract(b, CLOCK, i) for i in range(1, 5)]).alias("clock")))
        return bind(split, lambda x: stamp(x["date"], x["clock"], zone))

    return bind(F.trim(F.regexp_replace(F.trim(col_(c)), WEEKDAY, "")), parts)
