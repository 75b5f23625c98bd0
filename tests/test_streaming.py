"""Streaming alignment: replayed rows across files are dropped, sessions
match the batch operator."""

import datetime as dt

from pyspark.sql import functions as F

from sentibar.operators import calendar as CA
from sentibar.sources import fixtures as FX
from sentibar.sources.io import scratch_path
from sentibar.streaming import alignment as SA

T = dt.datetime


def test_stream_drops_redelivered_rows_and_aligns(spark):
    src = scratch_path(spark, "stream-src")
    schema = "news_id long, asset_tag string, time timestamp_ntz"
    first = [(1, "A", T(2024, 1, 5, 22, 0)), (2, "A", T(2024, 1, 8, 10, 0))]
    second = [(2, "A", T(2024, 1, 8, 10, 0)), (3, "B", T(2024, 1, 9, 23, 30))]   # id 2 again
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{src}/part=1")
    spark.createDataFrame(second, schema).coalesce(1).write.parquet(f"{src}/part=2")
    cal = FX.session_calendar(spark, ranges=(("2023-12-01", "2024-02-29"),))
    stream = SA.event_stream(spark, src, schema, max_files=1)          # one file per batch
    out = scratch_path(spark, "stream-out")
    SA.run_to_table(SA.aligned_stream(stream, cal, "time"), out, scratch_path(spark, "stream-ckpt"), "news_id")
    got = {r.news_id: r.trading_session for r in spark.read.parquet(out).collect()}
    batch = CA.align_to_sessions(spark.createDataFrame(first + second[1:], schema), cal)
    want = {r.news_id: r.trading_session for r in batch.collect()}
    assert got == want == {1: dt.date(2024, 1, 8), 2: dt.date(2024, 1, 8), 3: dt.date(2024, 1, 10)}


def test_daily_counts_stream_matches_batch(spark):
    src = scratch_path(spark, "counts-src")
    rows = [(i, "click" if i % 2 else "view", T(2024, 1, 1 + i % 3, i % 24), float(i)) for i in range(30)]
    schema = "event_id long, event_type string, ts timestamp_ntz, value double"
    spark.createDataFrame(rows, schema).write.parquet(src)
    agg = SA.daily_counts_stream(SA.event_stream(spark, src, schema), "ts", "event_type", "value")
    out = scratch_path(spark, "counts-out")
    SA.run_complete(agg, out, scratch_path(spark, "counts-ckpt"))
    got = {(r.day.date(), r.event_type): r.n for r in spark.read.parquet(out).collect()}
    df = spark.createDataFrame(rows, schema)
    want = {(r.d, r.event_type): r.n for r in
            df.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_rows_of_late_files_are_kept(spark):
    src = scratch_path(spark, "late-src")
    schema = "news_id long, asset_tag string, time timestamp_ntz"
    days = [20, 3, 25, 1, 14]                    # files arrive out of time order
    rows = [[(10 * d + i, "A", T(2024, 1, d, 9 + i)) for i in range(3)] for d in days]
    rows[3].append((None, "A", T(2024, 1, 1, 12)))
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/part={i}")
    cal = FX.session_calendar(spark, ranges=(("2023-12-01", "2024-02-29"),))
    out = scratch_path(spark, "late-out")
    SA.run_to_table(SA.aligned_stream(SA.event_stream(spark, src, schema, max_files=1), cal, "time"), out,
                    scratch_path(spark, "late-ckpt"), "news_id")
    got = sorted(r.news_id or 0 for r in spark.read.parquet(out).collect())
    assert got == sorted(r[0] or 0 for part in rows for r in part)
