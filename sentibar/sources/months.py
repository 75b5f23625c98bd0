"""A12/A13/A16 on stored tables: keyed updates that rewrite only what changed.

A table is partitioned by the month of a day column.  An update looks up the
months in which its keys occur (a join over the key columns alone), reads and
joins only those months, and puts them back with dynamic partition overwrite:
Spark writes them to a staging folder and swaps the month folders at commit,
so files of other months are not touched and keep their names.  Applying an
update twice gives the same table; after a lost driver the update is simply
run again.

Rows are dealt to files by (month, key hash), so a month with a large share of
all rows is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import first_wins, insert_ignore, keyed_update
from .io import path_exists, replace_table, scratch_path

MONTH = "session_month"
ROWS_PER_FILE = 1_000_000


def with_month(df: DataFrame, day: str) -> DataFrame:
    """Rows without a day have a month of their own."""
    return df.withColumn(MONTH, F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none")))


def _write(df: DataFrame, path: str, key, rows_per_file: int) -> None:
    key = [key] if isinstance(key, str) else list(key)
    df = replace_table(df, scratch_path(df.sparkSession, "months-staged"))   # counted, then dealt
    sizes = df.groupBy(MONTH).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files"))
    part = F.pmod(F.xxhash64(*key), F.col("_files")).alias("_part")
    dealt = df.join(F.broadcast(sizes), MONTH).withColumn("_part", part).drop("_files")   # one row a month
    (dealt.repartition(MONTH, "_part").drop("_part").write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file)
     .option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path))


def write_months(df: DataFrame, path: str, day: str, key, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Replace the months that occur in ``df`` (all of a new table)."""
    _write(with_month(df, day), path, key, rows_per_file)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def months_of(table: DataFrame, keys: DataFrame, key) -> list[str]:
    """The months in which the keys occur: a list as short as the calendar."""
    key = [key] if isinstance(key, str) else list(key)
    hit = table.select(*key, MONTH).join(keys.select(*key), key, "left_semi")
    return sorted(r[0] for r in hit.select(MONTH).distinct().collect())


def update_months(spark: SparkSession, path: str, updates: DataFrame, key, cols, order=None,
                  rows_per_file: int = ROWS_PER_FILE) -> list[str]:
    """``keys.keyed_update`` on the stored table.  Returns the months
    that were rewritten; unmatched updates rewrite nothing."""
    table = read_months(spark, path)
    missing = [c for c in cols if c not in table.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    months = months_of(table, updates, key)
    if months:
        hot = table.where(F.col(MONTH).isin(months))
        names = table.columns
        _write(keyed_update(hot, updates, key, cols, order).select(*names), path, key, rows_per_file)
    return months


def append_months(spark: SparkSession, path: str, incoming: DataFrame, day: str, key, order,
                  rows_per_file: int = ROWS_PER_FILE) -> list[str]:
    """Insert-ignore by key into the stored table.  Only the months of
    the incoming rows are read (a key belongs to one day) and rewritten; a day
    that is already there, row for row, rewrites nothing."""
    fresh = with_month(first_wins(incoming, key, order, keep=incoming.columns), day)
    if not path_exists(spark, path):
        _write(fresh, path, key, rows_per_file)
        return sorted(r[0] for r in read_months(spark, path).select(MONTH).distinct().collect())
    table = read_months(spark, path)
    asked = [r[0] for r in fresh.select(MONTH).distinct().collect()]
    there = table.where(F.col(MONTH).isin(asked))
    new = insert_ignore(there, fresh, key, order)
    new = replace_table(new, scratch_path(spark, "months-new"))
    months = sorted(r[0] for r in new.select(MONTH).distinct().collect())
    if months:
        kept = there.where(F.col(MONTH).isin(months)).select(*table.columns)
        _write(kept.unionByName(new.select(*table.columns)), path, key, rows_per_file)
    return months
