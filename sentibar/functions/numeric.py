"""Null-safe numeric column expressions.

Spark runs with ANSI mode on: ``x / 0`` raises, ``ln(x<=0)`` is NULL.  The
helpers below spell out the intended NULL semantics so the same result is
obtained on every engine (the DuckDB twins in ``plans.oracle`` mirror them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(col_(num), col_(den))


def log_ratio(num, den) -> Column:
    """ln(num / den) for positive operands, else NULL."""
    n, d = col_(num), col_(den)
    return F.when((n > 0) & (d > 0), F.ln(n / d))


def finite_or_null(c) -> Column:
    """NaN and +-Inf become NULL."""
    x = col_(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def clip(c, lo: float, hi: float) -> Column:
    """Bound a value into [lo, hi]; NULL stays NULL.

    ``greatest``/``least`` skip NULL arguments, hence the explicit guard.
    """
    x = col_(c)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used for engine-independent comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sanitize(df: DataFrame, cols) -> DataFrame:
    """Replace NaN/Inf by NULL in the given columns."""
    return df.withColumns({c: finite_or_null(c) for c in cols})


def ensure_columns(df: DataFrame, cols, fill: float = 0.0) -> DataFrame:
    """Add absent feature columns as a constant."""
    missing = {c: F.lit(fill).cast("double") for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def add_column_if_absent(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """Schema evolution by adding a typed NULL column when absent."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(None).cast(dtype))
