"""Incremental article alignment with Structured Streaming.

Source: a file stream of timestamped articles/events (parquet).  Plan:
stream-static join with the broadcast calendar day table (C7), stateless, so
a row counts however late its file arrives -> ``foreachBatch`` sink that keeps
the first row of each key and skips keys of earlier batches (an anti join with
the key column of the sink, which is the only state), and overwrites
``batch_id=<n>`` folders, so a replayed micro-batch after a failure rewrites
the same folder (idempotent).

``daily_counts_stream`` is the streaming form of the daily roll-up (D1/D2):
a 1-day tumbling window per asset; complete mode keeps one row per
(day, asset) in state, which is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.calendar import align_to_sessions
from ..sources.io import path_exists


def event_stream(spark: SparkSession, path: str, schema, max_files: int = 64,
                 base_path: str | None = None) -> DataFrame:
    """File stream over ``path`` (a directory or a glob of files)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if base_path:
        r = r.option("basePath", base_path)
    return r.parquet(path)


def aligned_stream(stream: DataFrame, calendar: DataFrame, ts: str,
                   calendar_rows: int | None = None) -> DataFrame:
    return align_to_sessions(stream, calendar, ts=ts, calendar_rows=calendar_rows)


def run_to_table(df: DataFrame, out: str, checkpoint: str, key: str) -> None:
    """Drain the stream (available-now trigger) into ``out`` idempotently, one
    row per ``key`` over all batches; rows without a key are all kept."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        if path_exists(spark, out):
            stored = T.StructType(list(batch.schema.fields)).add("batch_id", "long")
            seen = (spark.read.schema(stored).parquet(out)
                    .filter(F.col("batch_id") < batch_id).select(key))
            keyed = keyed.join(seen, key, "left_anti").select(*batch.columns)
        rows = keyed.unionByName(batch.filter(F.col(key).isNull()))
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (df.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def daily_counts_stream(stream: DataFrame, ts: str, group: str, value: str) -> DataFrame:
    """No watermark: complete mode keeps every (day, asset) row, however late."""
    ev = stream.withColumn("_wm", F.col(ts).cast("timestamp"))
    return (ev.groupBy(F.window("_wm", "1 day").alias("w"), group)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("day"), group, "n", "mean_value"))


def run_complete(df: DataFrame, out: str, checkpoint: str) -> None:
    """Complete mode: every batch rewrites the whole (bounded) result table."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (df.writeStream.outputMode("complete").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
