"""Query catalogue: name -> (Spark plan over the shared tables, SQL twin).

Every entry reads whole tables (or data Spark derives from them).  Spark
results have their double columns rounded to 6 digits; the SQL twin rounds
the columns listed in ``rnd`` the same way.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import round_doubles
from ..sources.tables import Tables
from .oracle import compose


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    ops: str = ""

    def run(self, spark, sf_dir: str) -> DataFrame:
        return normalise(self.build(Tables(spark, sf_dir)))


TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def normalise(df: DataFrame) -> DataFrame:
    """Engine-independent output: doubles rounded to 6 digits, dates and
    timestamps rendered as ISO strings."""
    df = round_doubles(df, 6)
    if any(isinstance(f.dataType, TEMPORAL) for f in df.schema.fields):
        df = df.select(*[F.col(f.name).cast("string").alias(f.name)
                         if isinstance(f.dataType, TEMPORAL) else F.col(f.name)
                         for f in df.schema.fields])
    return df


REGISTRY: dict[str, Query] = {}


def rounded_sql(body: str, rnd: tuple, dates: tuple, ctes: tuple) -> str:
    repl = [f"round({c}, 6) + 0.0 AS {c}" for c in rnd] + \
        [f"CAST({c} AS VARCHAR) AS {c}" for c in dates]
    if repl:
        body = f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{body}\n) _q"
    return compose(body, *ctes)


def register(name: str, sql: str | None = None, ctes: tuple = (), rnd: tuple = (),
             dates: tuple = ("trading_session",), ops: str = ""):
    def deco(fn):
        full = rounded_sql(sql, tuple(rnd), tuple(dates), tuple(ctes)) \
            if sql is not None else None
        REGISTRY[name] = Query(name, fn, full, ops)
        return fn
    return deco
