"""Deduplicated streams whose state is bounded by a watermark.

Two stages, each a checkpointed query that drains what is new:

1. The router is stateless.  A row is late if its time lies ``delay`` or more
   behind the latest time of earlier batches (their latest times are stored,
   one row a batch).  On-time rows go to ``<out>/ontime``, late rows to the
   table ``<out>/late``, rows without a time to ``<out>/untimed``, so no row is
   lost in silence.
2. The deduplicator streams the on-time rows through ``withWatermark`` and
   ``dropDuplicatesWithinWatermark``: the state store holds the keys of the last
   ``delay`` only, and forgets older ones.  Rows without a key are kept.

Both write ``batch_id=<n>`` folders by overwrite, so a replayed batch rewrites
its own folder, and a restarted stream goes on where its checkpoint ends.
Against the sink-wide anti join of :mod:`alignment` the cost of a batch does
not grow with history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import path_exists

def route(stream: DataFrame, out: str, checkpoint: str, ts: str, delay: str) -> None:
    """Drain the stream into ``ontime``, ``late`` and ``untimed``."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.col(ts).cast("timestamp")
        before = None
        if path_exists(spark, f"{out}/marks"):
            marks = spark.read.schema("latest timestamp, batch_id long").parquet(f"{out}/marks")
            before = marks.where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        # Spark's watermark refuses its own instant, too
        late = at <= F.lit(before) - F.expr(f"INTERVAL {delay}") if before is not None else F.lit(False)
        # what a batch marks counts from the next batch on
        put(batch.agg(F.max(at).alias("latest")), "marks", batch_id)
        put(batch.where(at.isNotNull() & ~late), "ontime", batch_id)
        put(batch.where(at.isNotNull() & late), "late", batch_id)
        put(batch.where(at.isNull()), "untimed", batch_id)

    def put(rows: DataFrame, table: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{table}/batch_id={batch_id}")

    drain(stream.writeStream.foreachBatch(write_batch), checkpoint)


def dedupe(spark: SparkSession, schema, out: str, checkpoint: str, key: str, ts: str, delay: str) -> None:
    """Drain ``ontime`` into ``<out>/rows``, one row a key within the watermark."""
    stored = f"{out}/ontime"
    if not path_exists(spark, stored):   # no batch yet
        return
    rows = spark.readStream.schema(schema).option("basePath", stored).parquet(f"{stored}/batch_id=*")
    rows = rows.select(*[f.name for f in schema.fields], F.col(ts).cast("timestamp").alias("_at"),
                       # a row without a key is its own key
                       F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\x00"), F.expr("uuid()"))).alias("_key"))
    kept = rows.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_at", "_key")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    drain(kept.writeStream.foreachBatch(write_batch), checkpoint)


def drain(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_within_watermark(stream: DataFrame, out: str, checkpoint: str, key: str, ts: str, delay: str) -> None:
    """Both stages; call again when files have arrived.  ``<out>/rows`` holds the
    deduplicated rows, ``<out>/late`` and ``<out>/untimed`` what the watermark
    refused."""
    route(stream, out, f"{checkpoint}/route", ts, delay)
    dedupe(stream.sparkSession, stream.schema, out, f"{checkpoint}/dedupe", key, ts, delay)
