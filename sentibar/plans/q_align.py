"""Registered queries: calendar alignment and keyed row operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as SC
from ..operators import calendar as CA
from ..operators import ingest as IN
from ..operators import keys as K
from ..sources import fixtures as FX
from ..sources import io as IO
from ..sources import months as MO
from .catalog import register
from .oracle import clean_html_sql, cte

CAL_ROWS = FX.calendar_day_count()


def news(t):
    return FX.news_from_orders(t.orders)


def calendar(t):
    return FX.session_calendar(t.spark)


def _asof_sql(ts: str) -> str:
    d = f"CAST({ts} AS DATE)"
    return (f"(SELECT min(c.session_date) FROM calendar c WHERE "
            f"(c.session_date > {d} AND c.session_date <= {d} + 7) OR "
            f"(c.session_date = {d} AND {ts} <= c.close_ts))")


def _next_sql(ts: str) -> str:
    d = f"CAST({ts} AS DATE)"
    return (f"(SELECT min(c.session_date) FROM calendar c WHERE "
            f"c.session_date > {d} AND c.session_date <= {d} + 7)")


@register("session_alignment", ops="C7",
          sql=f"SELECT n.news_id, n.asset_tag, n.time, {_asof_sql('n.time')} AS trading_session "
              "FROM news n",
          ctes=("news", "calendar"), dates=("time", "trading_session"))
def q_session_alignment(t):
    n = news(t).select("news_id", "asset_tag", "time")
    return CA.align_to_sessions(n, calendar(t), calendar_rows=CAL_ROWS)


@register("event_alignment", ops="C7",
          sql=f"SELECT e.event_id AS news_id, e.event_type AS asset_tag, e.ts AS time, "
              f"{_asof_sql('e.ts')} AS trading_session FROM events e",
          ctes=("calendar",), dates=("time", "trading_session"))
def q_event_alignment(t):
    ev = FX.events_as_articles(t.events).select("news_id", "asset_tag", "time")
    return CA.align_to_sessions(ev, calendar(t), calendar_rows=CAL_ROWS)


@register("after_close_shift_us", ops="C8",
          sql="SELECT n.news_id, n.time, CASE WHEN hour(n.time) * 60 + minute(n.time) >= 960 "
              f"THEN {_next_sql('n.time')} + INTERVAL 570 MINUTE ELSE n.time END AS shifted_time "
              "FROM news n",
          ctes=("news", "calendar"), dates=("time", "shifted_time"))
def q_after_close_us(t):
    n = news(t).select("news_id", "time")
    return CA.after_close_shift_us(n, calendar(t), calendar_rows=CAL_ROWS)


@register("after_close_shift_eg", ops="C9",
          sql="SELECT news_id, time, CASE WHEN hour(time) * 60 + minute(time) >= 870 THEN "
              "time + to_days(CAST(1 + CASE isodow(CAST(time AS DATE) + 1) WHEN 5 THEN 2 "
              "WHEN 6 THEN 1 ELSE 0 END AS INTEGER)) + to_hours(CAST(10 - hour(time) AS BIGINT)) "
              "- to_minutes(CAST(minute(time) AS BIGINT)) - to_seconds(CAST(second(time) AS BIGINT)) "
              "ELSE time END AS shifted_time FROM news",
          ctes=("news",), dates=("time", "shifted_time"))
def q_after_close_eg(t):
    return CA.after_close_shift_eg(news(t).select("news_id", "time"))


_EG_SHIFT = ("CASE WHEN hour({t}) * 60 + minute({t}) >= 870 THEN {t} + to_days(CAST(1 + CASE "
             "isodow(CAST({t} AS DATE) + 1) WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS INTEGER)) "
             "+ to_hours(CAST(10 - hour({t}) AS BIGINT)) - to_minutes(CAST(minute({t}) AS BIGINT)) "
             "- to_seconds(CAST(second({t}) AS BIGINT)) ELSE {t} END")
_US_SHIFT = ("CASE WHEN hour({t}) * 60 + minute({t}) >= 960 THEN {next} + INTERVAL 570 MINUTE ELSE {t} END")


def _shift_sql(asset: str, t: str) -> str:
    return (f"CASE {asset} WHEN 'R' THEN {_EG_SHIFT.format(t=t)} "
            f"ELSE {_US_SHIFT.format(t=t, next=_next_sql(t))} END")


# Fixture assets: A and N trade in New York, R from Sunday to Thursday.
US, EG = ("A", "N"), ("R",)


@register("asset_alignment", ops="C7 C10",
          sql=f"""SELECT n.news_id, n.asset_tag, n.time, CASE n.asset_tag
  WHEN 'R' THEN CAST(n.time AS DATE) + CASE isodow(CAST(n.time AS DATE)) WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END
  ELSE {_asof_sql('n.time')} END AS trading_session FROM news n""",
          ctes=("news", "calendar"), dates=("time", "trading_session"))
def q_asset_alignment(t):
    n = news(t).select("news_id", "asset_tag", "time")
    return CA.align_by_asset(n, calendar(t), us_assets=US, eg_assets=EG, calendar_rows=CAL_ROWS)


@register("asset_shift", ops="C8 C9",
          sql=f"SELECT n.news_id, n.asset_tag, n.time, {_shift_sql('n.asset_tag', 'n.time')} AS shifted_time FROM news n",
          ctes=("news", "calendar"), dates=("time", "shifted_time"))
def q_asset_shift(t):
    n = news(t).select("news_id", "asset_tag", "time")
    return CA.shift_by_asset(n, calendar(t), us_assets=US, eg_assets=EG, calendar_rows=CAL_ROWS)


# Each article twice under another id: the first delivery wins.
cte("raw_news", """  SELECT news_id, asset_tag, headline, summary, content, time, 0 AS delivery FROM news
  UNION ALL
  SELECT news_id + 1000000000 AS news_id, asset_tag, headline, 'again' AS summary, 'again' AS content, time, 1 AS delivery
  FROM news WHERE news_id % 3 = 0""", "news")


@register("ingest_news", ops="A3 B1 B2 B3 B4 B5 C8 C9 D23",
          sql=f"""SELECT time, arg_min(news_id, k) AS news_id, asset_tag, headline,
       nullif(arg_min(content, k), '~') AS content, nullif(arg_min(summary, k), '~') AS summary
FROM (SELECT {_shift_sql('r.asset_tag', 'r.time')} AS time, news_id, asset_tag, headline, (delivery, news_id) AS k,
             coalesce({clean_html_sql('content')}, '~') AS content, coalesce({clean_html_sql('summary')}, '~') AS summary
      FROM raw_news r WHERE r.time >= TIMESTAMP '1996-01-01' AND news_id % 13 <> 0) GROUP BY time, headline, asset_tag""",
          ctes=("raw_news", "calendar"), dates=("time",))
def q_ingest(t):
    n = news(t).select("news_id", "asset_tag", "headline", "summary", "content", "time", F.lit(0).alias("delivery"))
    again = n.filter(F.col("news_id") % 3 == 0).select(
        (F.col("news_id") + 1000000000).alias("news_id"), "asset_tag", "headline", F.lit("again").alias("summary"),
        F.lit("again").alias("content"), "time", F.lit(1).alias("delivery"))
    both = n.unionByName(again)
    # Three spellings of the time; one article in 13 has none.
    raw_time = (F.when(F.col("news_id") % 13 == 0, "n/a")
                .when(F.col("news_id") % 3 == 0, F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                .when(F.col("news_id") % 3 == 1, F.date_format("time", "MMMM d, yyyy HH:mm"))
                .otherwise(F.date_format("time", "dd MMM yyyy HH:mm:ss '+0000'")))
    raw = both.withColumn("raw_time", raw_time).withColumnRenamed("news_id", "id").withColumn("seq", F.col("id"))
    return IN.ingest_news(raw, calendar(t), ["delivery", "seq"], us_assets=US, eg_assets=EG, cutoff="1996-01-01",
                          calendar_rows=CAL_ROWS)


@register("weekmask_roll", ops="C10",
          sql="SELECT event_id, ts, CAST(ts AS DATE) + CASE isodow(CAST(ts AS DATE)) WHEN 5 THEN 2 "
              "WHEN 6 THEN 1 ELSE 0 END AS trading_session FROM events",
          ctes=(), dates=("ts", "trading_session"))
def q_weekmask(t):
    return CA.weekmask_roll(t.events.select("event_id", "ts"), ts="ts")


# ------------------------------------------------------------------ keys
cte("replies", """  SELECT news_id, asset_tag,
         'Sure: ```json ' || '{"asset": "' || asset_tag || '", "reasoning": "' || gemma_reasoning
         || '", "impact_type": "' || gemma_impact_type || '", "sentiment_score": '
         || coalesce(CAST(gemma_sentiment_score AS VARCHAR), 'null')
         || ', "confidence_score": ' || CAST(gemma_confidence_score AS VARCHAR)
         || CASE WHEN news_id % 17 = 0 THEN '' ELSE '}' END || ' ```' AS reply
  FROM news""", "news")
cte("rematch_feed", """  SELECT asset_tag, headline, CASE WHEN news_id % 7 = 0 THEN NULL ELSE news_id END AS fid,
         time AS raw_time, news_id AS ordinal FROM news""", "news")
cte("rematched", """  SELECT n.news_id, n.asset_tag, coalesce(i.v, h.v) AS raw_time
  FROM news n
  LEFT JOIN (SELECT asset_tag, fid, arg_min(raw_time, ordinal) AS v FROM rematch_feed
             WHERE fid IS NOT NULL GROUP BY asset_tag, fid) i
         ON n.asset_tag = i.asset_tag AND n.news_id = i.fid
  LEFT JOIN (SELECT asset_tag, headline, arg_min(raw_time, ordinal) AS v FROM rematch_feed
             WHERE fid IS NULL GROUP BY asset_tag, headline) h
         ON n.asset_tag = h.asset_tag AND n.headline = h.headline
  WHERE coalesce(i.v, h.v) IS NOT NULL""", "news", "rematch_feed")


@register("timestamp_rematch", ops="C6 C7 D23",
          sql=f"SELECT r.news_id, r.asset_tag, r.raw_time, {_asof_sql('r.raw_time')} AS trading_session "
              "FROM rematched r",
          ctes=("rematched", "calendar"), dates=("raw_time", "trading_session"))
def q_rematch(t):
    n = news(t)
    feed = n.select("asset_tag", "headline",
                    F.when(F.col("news_id") % 7 == 0, F.lit(None).cast("long"))
                    .otherwise(F.col("news_id")).alias("news_id"),
                    F.col("time").alias("raw_time"), F.col("news_id").alias("ordinal"))
    rows = n.select("news_id", "asset_tag", "headline")
    m = K.two_step_lookup(rows, feed).select("news_id", "asset_tag", "raw_time")
    return CA.align_to_sessions(m, calendar(t), ts="raw_time", calendar_rows=CAL_ROWS)


_LI_ORDER = "(l_partkey, l_suppkey, l_extendedprice, l_quantity)"


@register("insert_ignore", ops="A2 A3 C12",
          sql=f"""SELECT l_orderkey, l_linenumber,
       arg_min(l_partkey, {_LI_ORDER}) AS l_partkey, arg_min(l_suppkey, {_LI_ORDER}) AS l_suppkey,
       arg_min(l_extendedprice, {_LI_ORDER}) AS l_extendedprice,
       arg_min(l_quantity, {_LI_ORDER}) AS l_quantity
FROM lineitem
ANTI JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F') e
     USING (l_orderkey, l_linenumber)
GROUP BY l_orderkey, l_linenumber""",
          rnd=("l_extendedprice", "l_quantity"), dates=())
def q_insert_ignore(t):
    li = t.lineitem
    key = ["l_orderkey", "l_linenumber"]
    existing = li.filter(F.col("l_linestatus") == "F").select(*key)
    incoming = li.select(*key, "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return K.insert_ignore(existing, incoming, key,
                           ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])


@register("first_wins_dedupe", ops="D23 G2",
          sql="SELECT split_part(text, chr(10), 1) AS headline, min(doc_id) AS doc_id "
              "FROM documents GROUP BY 1", dates=())
def q_first_wins(t):
    d = FX.documents_as_articles(t.documents).select("headline", F.col("news_id").alias("doc_id"))
    return K.first_wins(d, "headline", "doc_id")


@register("merge_stats", ops="D24",
          sql="""SELECT count(DISTINCT source) AS files_scanned,
       (SELECT count(*) FROM (SELECT source FROM documents GROUP BY source
                              HAVING count(nullif(split_part(text, chr(10), 1), '')) = 0)) AS empty_files,
       count(DISTINCT nullif(split_part(text, chr(10), 1), '')) AS unique_records,
       count(nullif(split_part(text, chr(10), 1), '')) - count(DISTINCT nullif(split_part(text, chr(10), 1), '')) AS duplicates
FROM documents""", dates=())
def q_merge_stats(t):
    d = FX.documents_as_articles(t.documents)
    title = F.nullif(F.col("headline"), F.lit(""))
    per_file = d.groupBy("asset_tag").agg(F.count(title).alias("_n"))
    files = per_file.agg(F.count(F.lit(1)).alias("files_scanned"),
                         F.sum(F.when(F.col("_n") == 0, 1).otherwise(0)).cast("long")
                         .alias("empty_files"))
    # Distinct titles via a grouped pre-aggregation (no global distinct set).
    titles = d.filter(title.isNotNull()).groupBy("headline").agg(F.count(F.lit(1)).alias("_c"))
    unique = titles.agg(F.count(F.lit(1))).scalar()
    dups = titles.agg(F.sum("_c") - F.count(F.lit(1))).scalar()
    return files.select("files_scanned", "empty_files", unique.alias("unique_records"),
                        dups.alias("duplicates"))


@register("keyed_update", ops="A11 A12 A13 B11",
          sql="""SELECT n.news_id,
       CASE WHEN u.news_id IS NOT NULL THEN u.s END AS gemma_sentiment_score,
       CASE WHEN u.news_id IS NOT NULL THEN u.it END AS gemma_impact_type
FROM news n LEFT JOIN (
  SELECT news_id, TRY_CAST(json_extract(j, '$.sentiment_score') AS DOUBLE) AS s,
         json_extract_string(j, '$.impact_type') AS it
  FROM (SELECT news_id, regexp_extract(reply, '(?s)\\{.*\\}') AS j FROM replies)
  WHERE json_valid(j) AND j <> '') u ON n.news_id = u.news_id""",
          ctes=("news", "replies"), rnd=("gemma_sentiment_score",), dates=())
def q_keyed_update(t):
    target = news(t).select("news_id", "asset_tag", "headline")
    rep = FX.reply_text_from_orders(t.orders).select("news_id", "reply")
    parsed = (SC.with_reply_fields(rep, "reply", keep_valid_only=True)
              .select("news_id", F.col("sentiment_score").alias("gemma_sentiment_score"),
                      F.col("impact_type").alias("gemma_impact_type")))
    out = K.keyed_update(target, parsed, "news_id", ["gemma_sentiment_score", "gemma_impact_type"])
    return out.select("news_id", "gemma_sentiment_score", "gemma_impact_type")


@register("month_update", ops="A12 A13 (only the months concerned are rewritten)",
          sql="""SELECT n.news_id, strftime(n.time, '%Y-%m') AS session_month,
       CASE WHEN u.news_id IS NOT NULL THEN u.s END AS gemma_sentiment_score,
       CASE WHEN u.news_id IS NOT NULL THEN u.it END AS gemma_impact_type
FROM news n LEFT JOIN (
  SELECT news_id, TRY_CAST(json_extract(j, '$.sentiment_score') AS DOUBLE) AS s,
         json_extract_string(j, '$.impact_type') AS it
  FROM (SELECT news_id, regexp_extract(reply, '(?s)\\{.*\\}') AS j FROM replies)
  WHERE json_valid(j) AND j <> '') u ON n.news_id = u.news_id AND year(n.time) = 1995""",
          ctes=("news", "replies"), rnd=("gemma_sentiment_score",), dates=())
def q_month_update(t):
    """Scores of one year's articles put into a table stored by month."""
    path = IO.scratch_path(t.spark, "news-months")
    n = news(t).select("news_id", "asset_tag", "time", "headline")
    MO.write_months(n.withColumns({"gemma_sentiment_score": F.lit(None).cast("double"),
                                   "gemma_impact_type": F.lit(None).cast("string")}), path, "time", "news_id")
    rep = FX.reply_text_from_orders(t.orders).select("news_id", "reply")
    parsed = (SC.with_reply_fields(rep, "reply", keep_valid_only=True)
              .select("news_id", F.col("sentiment_score").alias("gemma_sentiment_score"),
                      F.col("impact_type").alias("gemma_impact_type")))
    year = n.filter(F.year("time") == 1995).select("news_id")
    MO.update_months(t.spark, path, parsed.join(year, "news_id", "left_semi"), "news_id",
                     ["gemma_sentiment_score", "gemma_impact_type"])
    return MO.read_months(t.spark, path).select("news_id", F.col("session_month").cast("string").alias("session_month"),
                                                "gemma_sentiment_score", "gemma_impact_type")


@register("month_append", ops="A2 A16 (insert-ignore into months)",
          sql="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END AS value FROM events",
          rnd=("value",), dates=())
def q_month_append(t):
    """Half of the events are stored; all of them arrive again with other values."""
    path = IO.scratch_path(t.spark, "event-months")
    ev = t.events.select("event_id", "ts", "value")
    MO.write_months(ev.filter(F.col("event_id") % 2 == 0), path, "ts", "event_id")
    MO.append_months(t.spark, path, ev.withColumn("value", F.col("value") + 1), "ts", "event_id", ["ts", "value"])
    return MO.read_months(t.spark, path).select("event_id", "value")


@register("pending_rows", ops="A14",
          sql="SELECT news_id, asset_tag, headline FROM news WHERE gemma_sentiment_score IS NULL",
          ctes=("news",), dates=())
def q_pending(t):
    return K.pending(news(t), "gemma_sentiment_score").select("news_id", "asset_tag", "headline")


@register("anti_processed_days", ops="A16 C12",
          sql="""SELECT DISTINCT a.day, a.hour FROM
  (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour FROM events) a
ANTI JOIN (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour FROM events WHERE event_type = 'error') e
     USING (day, hour)""",
          dates=("day",))
def q_anti_days(t):
    ev = t.events.select(F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("hour"),
                         "event_type")
    done = ev.filter(F.col("event_type") == "error")
    return K.anti(ev.select("day", "hour").distinct(), done, ["day", "hour"])


@register("anti_keys", ops="C12",
          sql="SELECT n.news_id, n.asset_tag FROM news n ANTI JOIN "
              "(SELECT DISTINCT l_orderkey FROM lineitem) l ON n.news_id = l.l_orderkey",
          ctes=("news",), dates=())
def q_anti_keys(t):
    """Articles whose key has no match in an existing key set (here: orders
    without line items)."""
    done = t.lineitem.select(F.col("l_orderkey").alias("news_id"))
    return K.anti(news(t).select("news_id", "asset_tag"), done, "news_id")
