"""Keyed row operations: dedupe, insert-ignore, keyed update, anti joins
(A2, A3, A12-A14, A16, C6, C12, D23).

First-wins dedupe is ``groupBy(key).agg(min_by(struct(row), ordinal))``:
``min_by`` is a partial aggregate, so a key repeated across a third of the
input is reduced map-side and never sorted in one task (a ``row_number``
window would put the whole hot key into one partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_wins(df: DataFrame, key, order, keep=None) -> DataFrame:
    """One row per key, the one with the smallest ``order`` value.

    ``order`` is a column name or list of names forming a total order (add a
    unique column to break ties)."""
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    keep = [c for c in (keep or df.columns) if c not in key]
    fixed = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
             T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
    types = {f.name: f.dataType for f in df.schema.fields}
    if len(order) == 1 and all(isinstance(types[c], fixed) for c in keep + order):
        # One total-order column and fixed-width values: one min_by per
        # column (all pick the same row) keeps a fixed-width buffer, so
        # Spark aggregates in a hash map instead of sorting.
        return df.groupBy(*key).agg(*[F.min_by(c, order[0]).alias(c) for c in keep])
    best = F.min_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_row")).select(*key, "_row.*")


def insert_ignore(target: DataFrame | None, incoming: DataFrame, key, order) -> DataFrame:
    """A2/A3: rows of ``incoming`` whose key is new, first occurrence wins;
    existing target rows win over incoming ones.  Returns the rows to append
    (``target`` may be None for a truncate-then-insert load)."""
    fresh = first_wins(incoming, key, order, keep=incoming.columns)
    if target is None:
        return fresh
    key = [key] if isinstance(key, str) else list(key)
    return fresh.join(target.select(*key), key, "left_anti")


def keyed_update(target: DataFrame, updates: DataFrame, key, cols, order=None) -> DataFrame:
    """Set ``cols`` from ``updates`` where the key matches; unmatched
    target rows keep their value; columns absent in target are added.

    Never multiplies target rows: of several updates of a key the first by
    ``order`` applies (without ``order``, the one with the smallest values).
    The reduction is a partial aggregate on the join key, so the join reuses
    its shuffle."""
    key = [key] if isinstance(key, str) else list(key)
    cols = list(cols)
    one = first_wins(updates, key, order if order is not None else cols, keep=cols)
    u = one.select(*key, F.lit(True).alias("_matched"),
                   *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = target.join(u, key, "left")
    out = {}
    for c in cols:
        old = F.col(c) if c in target.columns else F.lit(None).cast(updates.schema[c].dataType)
        out[c] = F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(old)
    return j.withColumns(out).drop("_matched", *[f"_new_{c}" for c in cols])


def pending(df: DataFrame, col: str) -> DataFrame:
    """Rows still waiting for a value in ``col``."""
    return df.filter(F.col(col).isNull())


def anti(df: DataFrame, done: DataFrame, key) -> DataFrame:
    """Rows whose key is not yet present in ``done``."""
    key = [key] if isinstance(key, str) else list(key)
    # Duplicates on the right do not change an anti join: no distinct (no extra shuffle).
    return df.join(done.select(*key), key, "left_anti")


def two_step_lookup(rows: DataFrame, feed: DataFrame, tag: str = "asset_tag",
                    id_col: str = "news_id", text: str = "headline",
                    value: str = "raw_time", order: str = "ordinal") -> DataFrame:
    """Attach ``value`` from ``feed`` by (tag, id); rows without an id
    match, fall back to (tag, text) over feed rows that have no id.  First
    feed occurrence wins per key; rows matching neither are dropped."""
    by_id = first_wins(feed.filter(F.col(id_col).isNotNull()), [tag, id_col], order,
                       keep=[value]).withColumnRenamed(value, "_v_id")
    by_text = first_wins(feed.filter(F.col(id_col).isNull()), [tag, text], order,
                         keep=[value]).withColumnRenamed(value, "_v_text")
    # Rows without an id cannot match by id: they skip that join, so a feed
    # without ids does not hash to one key per asset.
    with_id = rows.filter(F.col(id_col).isNotNull()).join(by_id, [tag, id_col], "left")
    without = rows.filter(F.col(id_col).isNull()).withColumn(
        "_v_id", F.lit(None).cast(feed.schema[value].dataType))
    j = with_id.unionByName(without).join(by_text, [tag, text], "left")
    return (j.withColumn(value, F.coalesce("_v_id", "_v_text"))
            .filter(F.col(value).isNotNull()).drop("_v_id", "_v_text"))
