"""Streams deduplicated within a watermark."""

import datetime as dt
import os

from sentibar.sources.io import scratch_path
from sentibar.streaming import alignment as SA
from sentibar.streaming import watermark as SW

T = dt.datetime
SCHEMA = "k long, ts timestamp_ntz, v string"


def deliver(spark, src, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/part={name}")


def table(spark, out, name):
    if not os.path.exists(f"{out}/{name}".replace("file:", "")):
        return []
    return sorted(((r.k, r.v) for r in spark.read.schema("k long, v string").parquet(f"{out}/{name}").collect()), key=repr)


def test_late_rows_restart_and_bounded_state(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("wm-src", "wm-out", "wm-ck"))

    def run():
        stream = SA.event_stream(spark, src, "k long, ts timestamp_ntz, v string", max_files=1)
        SW.run_within_watermark(stream.select("k", "ts", "v"), out, ck, "k", "ts", "2 days")

    deliver(spark, src, 1, [(1, T(2024, 1, 1), "a"), (2, T(2024, 1, 5), "b"), (2, T(2024, 1, 5), "b"),
                            (None, T(2024, 1, 5), "n"), (None, T(2024, 1, 5), "n"), (9, None, "u")])
    run()
    # restarted with more files: a repeated key, a row two days behind, a row just within
    deliver(spark, src, 2, [(2, T(2024, 1, 5), "again"), (3, T(2024, 1, 3), "late"), (4, T(2024, 1, 3, 0, 1), "near")])
    deliver(spark, src, 3, [(5, T(2024, 2, 1), "c"), (4, T(2024, 1, 4), "again")])
    run()
    deliver(spark, src, 4, [(5, T(2024, 2, 1), "again"), (6, T(2024, 1, 6), "late"), (2, T(2024, 2, 2), "forgotten")])
    run()
    run()                                               # nothing new
    # a key that is older than the watermark is forgotten: the state does not grow with history
    assert table(spark, out, "rows") == sorted([(1, "a"), (2, "b"), (None, "n"), (None, "n"), (4, "near"), (5, "c"),
                                                (2, "forgotten")], key=repr)
    assert table(spark, out, "late") == [(3, "late"), (6, "late")]
    assert table(spark, out, "untimed") == [(9, "u")]
