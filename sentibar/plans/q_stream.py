"""Registered queries: streaming forms of alignment and the daily roll-up.

Both drain a file stream over the whole events table and read the sink
back; the results equal the batch plans, so they carry SQL twins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as FX
from ..sources.io import scratch_path
from ..streaming import alignment as SA
from ..streaming import watermark as SW
from .catalog import register
from .q_align import CAL_ROWS, _asof_sql


def _events_stream(t):
    # The shared tables are single files: stream the file through a glob
    # rooted at its folder (a real feed is a folder that receives new files).
    base = t.sf_dir.rstrip("/")
    return SA.event_stream(t.spark, f"{base}/event[s].parquet", t.events.schema, base_path=base)


@register("stream_alignment", ops="C7 A12 (streaming)",
          sql=f"SELECT e.event_id AS news_id, e.event_type AS asset_tag, e.ts AS time, "
              f"{_asof_sql('e.ts')} AS trading_session FROM events e",
          ctes=("calendar",), dates=("time", "trading_session"))
def q_stream_alignment(t):
    ev = FX.events_as_articles(_events_stream(t)).select("news_id", "asset_tag", "time")
    out = scratch_path(t.spark, "aligned-stream")
    SA.run_to_table(SA.aligned_stream(ev, FX.session_calendar(t.spark), "time", calendar_rows=CAL_ROWS),
                    out, scratch_path(t.spark, "aligned-stream-ckpt"), "news_id")
    return t.spark.read.parquet(out).drop("batch_id")


@register("stream_daily_counts", ops="D1 D2 (streaming window)",
          sql="SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, avg(value) AS mean_value "
              "FROM events GROUP BY 1, 2",
          rnd=("mean_value",), dates=("day",))
def q_stream_daily(t):
    agg = SA.daily_counts_stream(_events_stream(t), "ts", "event_type", "value")
    out = scratch_path(t.spark, "daily-stream")
    SA.run_complete(agg, out, scratch_path(t.spark, "daily-stream-ckpt"))
    return t.spark.read.parquet(out).select("day", "event_type", F.col("n").cast("long").alias("n"),
                                            "mean_value")


@register("stream_watermark", ops="A2 A12 (streaming, state bounded by a watermark)",
          sql="SELECT event_id, event_type, ts, value FROM events", rnd=("value",), dates=("ts",))
def q_stream_watermark(t):
    """Events, a third of them delivered again, deduplicated within ten days."""
    ev = _events_stream(t).select("event_id", "event_type", "ts", "value")
    both = ev.unionByName(ev.filter(F.col("event_id") % 3 == 0))
    out = scratch_path(t.spark, "watermark-stream")
    SW.run_within_watermark(both, out, scratch_path(t.spark, "watermark-ckpt"), "event_id", "ts", "10 days")
    return t.spark.read.parquet(f"{out}/rows").select("event_id", "event_type", "ts", "value")
