"""Join helpers: size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def broadcast_if_bounded(df: DataFrame, max_bytes: int = 64 << 20,
                         known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its size is proven to be small.

    ``known_rows`` is a bound derived on the driver from parameters (e.g. a
    calendar's date range); times the row width of the schema it bounds the
    bytes.  Without it, or beyond ``max_bytes``, the plain DataFrame is
    returned and Spark/AQE choose the join from runtime statistics.
    """
    if known_rows is None:
        return df
    width = sum(8 if isinstance(f.dataType, FIXED) else 64 for f in df.schema.fields) + 16
    return F.broadcast(df) if known_rows * width <= max_bytes else df
