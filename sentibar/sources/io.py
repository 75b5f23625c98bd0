"""Readers and writers.

Files go to and come from storage every executor can reach; scratch
output of the library lives under the session's ``spark.checkpoint.dir``
(shared storage on a cluster), never in a machine-local folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_nonempty, tags_flatten
from ..session import ensure_checkpoint_dir

BAR_CSV_SCHEMA = T.StructType([
    T.StructField("datetime", T.StringType()), T.StructField("symbol", T.StringType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

# Every field is read as text (any JSON value has a text form), so only a file
# that is not JSON counts as undecodable.
ARTICLE_JSON_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("headline", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("lead", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("time", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("tags", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sentibar-out/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- CSV bars
def write_bars_csv(bars: DataFrame, path: str) -> None:
    """Header CSV with a ``datetime`` column."""
    (bars.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "symbol",
                 "open", "high", "low", "close", "volume")
     .write.mode("overwrite").option("header", True).csv(path))


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: header CSV with an explicit schema; ``datetime`` -> ``time``."""
    return read_bars_csv_ordered(spark, path).drop(*FILE_ORDER)


FILE_ORDER = ["_file", "_block", "_pos"]


def read_bars_csv_ordered(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_bars_csv``, with the row's place: file path, byte offset of
    its split, and position in the split (``FILE_ORDER``)."""
    raw = (spark.read.schema(BAR_CSV_SCHEMA).option("header", True)
           .option("recursiveFileLookup", True).csv(path))
    return raw.select(F.to_timestamp_ntz("datetime").alias("time"), "symbol", "open", "high",
                      "low", "close", "volume", F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_pos")).filter(F.col("time").isNotNull())


# ------------------------------------------------------------- JSON files
def write_json_arrays(df: DataFrame, path: str, file_key: str, order: str) -> None:
    """Write one JSON array per ``file_key`` value (one file per value), its
    rows by ``order`` (which is not written).

    ``file_key`` must bound the rows per file (e.g. a day or a fixed-size
    bucket of ids): each file's rows are gathered into one array."""
    row = F.struct(*[c for c in df.columns if c not in (file_key, order)]).alias("row")
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), row))), lambda x: x["row"])
    arr = df.groupBy(file_key).agg(F.to_json(rows).alias("value"))
    arr.write.mode("overwrite").partitionBy(file_key).text(path)


def read_json_articles(spark: SparkSession, path: str, schema=ARTICLE_JSON_SCHEMA) -> DataFrame:
    """A4/A5: JSON array files; a file that does not decode is skipped whole.

    The multi-line reader parses a file as one stream and turns one that is not
    JSON into a single row with ``_corrupt_record``, so one pass reads the
    records and marks bad files, whatever the file size.  Repeated keys of an
    object keep the last value.  A file is one task, and ``(file, position)``
    is the ingest order: feeds should deliver many files, not one huge one."""
    return (_json_files(spark, path, schema).filter(~_is_bad(schema))
            .drop("_corrupt_record").withColumn("id", F.expr("try_cast(id AS BIGINT)")))


def _is_bad(schema) -> F.Column:
    """The one row of an undecodable file: a corrupt record without data."""
    data = next(n for n in schema.names if n != "_corrupt_record")
    return F.col("_corrupt_record").isNotNull() & F.col(data).isNull()


def _json_files(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("multiLine", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("recursiveFileLookup", True).json(path)
            .withColumn("_file", F.col("_metadata.file_path"))
            .withColumn("_pos", F.monotonically_increasing_id()))


def file_stats(spark: SparkSession, path: str, schema=ARTICLE_JSON_SCHEMA) -> DataFrame:
    """D24 inputs: per file, whether it is empty (no record) or undecodable.
    The parser decides; the file list reads no content.  Files of zero bytes are
    not part of a Spark listing."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select(F.col("_metadata.file_path").alias("_file"), "length"))
    seen = (_json_files(spark, path, schema).groupBy("_file")
            .agg(F.max(_is_bad(schema)).alias("_bad")))
    j = files.join(seen, "_file", "left")
    invalid = F.coalesce("_bad", F.lit(False))
    return j.select("_file", invalid.alias("invalid"), (F.col("_bad").isNull() & ~invalid).alias("empty"))


def normalise_articles(df: DataFrame) -> DataFrame:
    """B1-B4, B22, B23 over raw article records of several providers."""
    return df.select(
        first_nonempty("headline", "title").alias("headline"),
        first_nonempty("summary", "lead").alias("summary"),
        first_nonempty("content", "body").alias("content"),
        first_nonempty("created_at", "time", "date").alias("raw_time"),
        "id", "_file", "_pos", flatten_tags(F.col("tags")).alias("tags"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("category", "author", "provider", "url")],
    )


def flatten_tags(tags) -> F.Column:
    """B22 on raw JSON text: a list becomes pipe-joined, a string stays, a
    missing value becomes ''."""
    as_list = F.from_json(tags, "array<string>")
    return (F.when(tags.isNull(), F.lit(""))
            .when(F.trim(tags).startswith("["), F.coalesce(tags_flatten(as_list), F.lit("")))
            .otherwise(tags))


def write_json_lines(df: DataFrame, path: str) -> None:
    """UTF-8 JSON output (one object per line); every kept key is
    written, also when its value is null."""
    (df.write.mode("overwrite").option("encoding", "UTF-8")
     .option("ignoreNullFields", False).json(path))


# ------------------------------------------------------------ table sinks
def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Overwrite the table at ``path`` and return a scan of it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed_table(df: DataFrame, name: str, path: str, keys, buckets: int) -> DataFrame:
    """A9 for tables that are joined again and again: written to ``path`` in
    ``buckets`` by ``keys``, sorted by them, and named in the session's catalog.
    Joins of such tables on ``keys`` need no exchange.  Every table of one
    family takes the same bucket count."""
    spark = df.sparkSession
    # one file a bucket: the writer's tasks hold whole buckets
    dealt = df.repartition(buckets, *keys)
    (dealt.write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return spark.table(name)


def read_bucketed(spark: SparkSession, name: str, path: str) -> DataFrame | None:
    """The table by its name, so that its buckets are known; by its path in a
    session that has not written it; None if it was never written."""
    if not path_exists(spark, path):
        return None
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The table if it exists, else None (callers substitute)."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def describe(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Column names and types (of the first ``limit`` columns, if given)."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields[:limit]]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string")

