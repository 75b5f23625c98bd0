"""Trend with changepoints and a yearly season, per series.

``y = b0 + b1 t + sum_j d_j max(0, t - s_j) + season`` with ``t`` running from 0
to 1 over the series, changepoints ``s_j`` evenly over its first 80 %, and pairs
of sines and cosines of the year.  The slopes may change at every ``s_j``; a
penalty on the ``d_j`` keeps those small that the data do not ask for.

The normal equations are sums of products of two regressors, one grouped and
partially aggregated sum for all series, whatever their length.  They are
solved per series in a column expression: a fold over the pivots eliminates one
after the other (the matrix is positive definite, so no row is exchanged).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGEPOINTS, SPAN, PAIRS, PERIOD = 12, 0.8, 2, 365.25


def term_names(changepoints: int = CHANGEPOINTS, pairs: int = PAIRS) -> list[str]:
    return (["one", "t"] + [f"hinge_{j}" for j in range(1, changepoints + 1)]
            + [f"{f}_{k}" for k in range(1, pairs + 1) for f in ("sin", "cos")])


def regressors(df: DataFrame, y: str, day: str, group: str, changepoints: int = CHANGEPOINTS,
               pairs: int = PAIRS) -> DataFrame:
    """``(group, day, x, y)``: the regressors of every row with a value."""
    whole = Window.partitionBy(group)
    at = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")
    rows = df.where(F.col(y).isNotNull() & F.col(day).isNotNull()).select(
        group, day, F.col(y).cast("double").alias("y"), at.alias("_d"))
    rows = rows.withColumns({"_a": F.min("_d").over(whole), "_b": F.max("_d").over(whole)})
    t = F.coalesce(F.try_divide(F.col("_d") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))
    hinges = [F.greatest(F.col("_t") - F.lit(SPAN * j / (changepoints + 1)), F.lit(0.0))
              for j in range(1, changepoints + 1)]
    season = [f(F.lit(2 * math.pi * k / PERIOD) * F.col("_d")) for k in range(1, pairs + 1) for f in (F.sin, F.cos)]
    return rows.withColumn("_t", t).select(group, day, F.array(F.lit(1.0), F.col("_t"), *hinges, *season).alias("x"), "y")


def gram(rows: DataFrame, group: str) -> DataFrame:
    """``(group, i, j, s)``: sums of products, ``j <= i``; the target is the last regressor."""
    z = rows.select(group, F.concat("x", F.array("y")).alias("z"))
    z = z.select(group, "z", F.posexplode("z").alias("i", "a"))
    pairs = z.select(group, "i", "a", F.posexplode(F.slice("z", F.lit(1), F.col("i") + 1)).alias("j", "b"))
    return pairs.groupBy(group, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))


def solve_positive(matrix: Column, p: int) -> Column:
    """The solution of a positive definite system given as rows with the right
    side behind them; a pivot that vanishes gives that unknown zero."""
    def eliminate(m, k):
        pivot = F.get(m, k)
        lead = F.get(pivot, k)
        dead = F.abs(lead) < 1e-12
        return F.transform(m, lambda r, i: F.when(dead & (i == k), F.transform(r, lambda _: F.lit(0.0)))
                           .when(dead, r)
                           .when(i == k, F.transform(r, lambda v: v / lead))
                           .otherwise(F.zip_with(r, pivot, lambda a, b: a - F.get(r, k) / lead * b)))

    steps = F.sequence(F.lit(0), F.lit(p - 1))
    return F.aggregate(steps, matrix, eliminate, lambda m: F.transform(m, lambda r: F.get(r, F.lit(p))))


def trend_fit(df: DataFrame, y: str = "close", day: str = "trading_session", group: str = "asset_tag",
              changepoints: int = CHANGEPOINTS, pairs: int = PAIRS, penalty: float = 0.01) -> DataFrame:
    """``(group, term, at, coefficient, n, rmse)``: the fitted terms; ``at`` is a
    changepoint's place on the series (0 to 1).  ``penalty`` times the number of
    rows is added to the diagonal of the hinges.  A series without rows has none."""
    names = term_names(changepoints, pairs)
    p = len(names)
    rows = regressors(df, y, day, group, changepoints, pairs)
    both = F.array(F.struct("i", "j", "s"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    entry = gram(rows, group).select(group, F.explode(both).alias("e")).select(group, "e.*").distinct()
    line = entry.groupBy(group, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))),
                                                     lambda e: e["s"]).alias("row"))     # p + 1 numbers
    square = line.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))),
                                                 lambda r: r["row"]).alias("m"))          # p + 1 rows
    n = F.get(F.get("m", F.lit(0)), F.lit(0))
    hinge = F.array(*[F.lit(float(x.startswith("hinge"))) for x in names])
    system = F.transform(F.slice("m", 1, p), lambda r, i: F.transform(
        r, lambda v, j: F.when(i == j, v + F.get(hinge, i) * F.lit(penalty) * n).otherwise(v)))
    fit = square.select(group, n.alias("n"), "m", solve_positive(system, p).alias("b"))
    # y'y - 2 b'x'y + b'x'x b
    last = F.get("m", F.lit(p))
    fitted = F.aggregate(F.zip_with("b", F.slice(last, 1, p), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
    spread = F.aggregate(F.zip_with("b", F.transform(F.slice("m", 1, p), lambda r: F.aggregate(
        F.zip_with(F.slice(r, 1, p), F.col("b"), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)),
        lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
    sse = F.greatest(F.get(last, F.lit(p)) - 2 * fitted + spread, F.lit(0.0))
    out = fit.select(group, "n", F.sqrt(sse / F.col("n")).alias("rmse"), F.posexplode("b").alias("i", "coefficient"))
    term = F.get(F.array(*[F.lit(x) for x in names]), F.col("i"))
    at = F.when(term.startswith("hinge"), (F.col("i") - 1) * SPAN / (changepoints + 1))
    return out.select(group, term.alias("term"), at.alias("at"), "coefficient", F.col("n").cast("long").alias("n"), "rmse")
