"""Readers for the shared parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


#: Few enough splits that dealing their rows anew costs less than idle cores.
SPREAD_MAX_SPLITS = 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least as many partitions as the session has cores.

    Used in front of CPU-heavy per-row work (regex HTML cleaning, JSON
    parsing, tokenising whole texts): a single-row-group file is one split,
    so that work would run in one task.  Large inputs already have more
    splits than cores and are returned unchanged; column pruning and
    filters still reach the scan below the repartition.  Aggregation inputs
    are not spread: their partial aggregation is cheap per row.

    Only an input of at most ``SPREAD_MAX_SPLITS`` splits is dealt anew, so a
    large table is never shuffled because the cluster has still more cores."""
    target = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(target) if splits < min(target, SPREAD_MAX_SPLITS) else df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` is a parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
