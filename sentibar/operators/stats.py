"""Closed-form statistics as grouped aggregates.

Regressions use the SQL regression aggregates (``regr_sxx`` and friends),
which Spark combines map-side; information criteria follow from the sums
with the Gaussian log-likelihood of OLS.  Nothing is collected: one row of
coefficients per series comes out of one aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as FV

LN_2PI = math.log(2 * math.pi)
SEQ_BLOCK = 512           # rows of a series whose look-back sequences one group makes


def ols_loglik(n: Column, ssr: Column) -> Column:
    return -n / 2 * (F.lit(LN_2PI) + F.ln(ssr / n) + 1)


def info_criteria(ll: Column, k: Column, n: Column):
    return (-2 * ll + 2 * k), (-2 * ll + k * F.ln(n))


def market_model(df: DataFrame, y: str, x: str, group: str = "asset_tag") -> DataFrame:
    """H1: y = a + b x + e per group; beta, alpha, AIC, BIC (k = 2).

    A constant regressor leaves the model (beta 0, k = 1); its group keeps its
    row."""
    n = F.regr_count(y, x).cast("double")
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    agg = df.groupBy(group).agg(n.alias("n"), sxx.alias("sxx"), syy.alias("syy"),
                                sxy.alias("sxy"), F.regr_avgy(y, x).alias("my"),
                                F.regr_avgx(y, x).alias("mx"))
    flat = ~F.coalesce(F.col("sxx") > 0, F.lit(False))
    beta = F.when(flat, F.lit(0.0)).otherwise(F.try_divide("sxy", "sxx"))
    ll = ols_loglik(F.col("n"), F.col("syy") - beta * F.col("sxy"))
    aic, bic = info_criteria(ll, F.when(flat, F.lit(1.0)).otherwise(F.lit(2.0)), F.col("n"))
    return agg.select(group, beta.alias("beta"), (F.col("my") - beta * F.col("mx")).alias("alpha"),
                      F.col("n").cast("long").alias("n"), ll.alias("loglik"),
                      aic.alias("aic"), bic.alias("bic"))


def two_factor(df: DataFrame, y: str, x1: str, x2: str, group: str = "asset_tag",
               collinear_tol: float = 1e-10) -> DataFrame:
    """H2: y = a + b1 x1 + b2 x2 + e.  Solved from centred cross products;
    when x2 is (numerically) collinear with x1 the factor is dropped and the
    model is the one-factor fit with k = 2, as a rank-aware OLS reports.  A
    constant regressor leaves the model the same way (both constant: k = 1)."""
    agg = df.groupBy(group).agg(
        F.regr_count(y, x1).cast("double").alias("n"),
        F.regr_sxx(y, x1).alias("s11"), F.regr_sxx(y, x2).alias("s22"),
        F.regr_sxy(x2, x1).alias("s12"), F.regr_sxy(y, x1).alias("s1y"),
        F.regr_sxy(y, x2).alias("s2y"), F.regr_syy(y, x1).alias("syy"))
    s11, s22, s12 = F.col("s11"), F.col("s22"), F.col("s12")
    det = s11 * s22 - s12 * s12
    collinear = F.coalesce(F.abs(det) <= F.lit(collinear_tol) * s11 * s22, F.lit(True))
    use1 = F.coalesce(s11 > 0, F.lit(False))
    use2 = F.when(collinear, ~use1 & F.coalesce(s22 > 0, F.lit(False))).otherwise(F.lit(True))
    b1 = (F.when(~use1, F.lit(0.0)).when(collinear, F.try_divide(F.col("s1y"), s11))
          .otherwise(F.try_divide(s22 * F.col("s1y") - s12 * F.col("s2y"), det)))
    b2 = (F.when(~use2, F.lit(0.0)).when(collinear, F.try_divide(F.col("s2y"), s22))
          .otherwise(F.try_divide(s11 * F.col("s2y") - s12 * F.col("s1y"), det)))
    rank = F.lit(1.0) + use1.cast("double") + use2.cast("double")
    out = agg.select(group, "n", "syy", "s1y", "s2y", collinear.alias("collinear"), rank.alias("k"),
                     b1.alias("beta_market"), b2.alias("beta_factor"))
    ssr = F.col("syy") - F.col("beta_market") * F.col("s1y") - F.col("beta_factor") * F.col("s2y")
    k = F.col("k")
    ll = ols_loglik(F.col("n"), ssr)
    aic, bic = info_criteria(ll, k, F.col("n"))
    return out.select(group, "beta_market", "beta_factor", "collinear",
                      k.cast("int").alias("k"), F.col("n").cast("long").alias("n"),
                      ll.alias("loglik"), aic.alias("aic"), bic.alias("bic"))


def trend_line(df: DataFrame, y: str, x: str, group: str = "asset_tag") -> DataFrame:
    """Least-squares line of y on x per group."""
    return df.groupBy(group).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def chrono_split(df: DataFrame, frac: float = FV.TRAIN_FRACTION, group: str = "asset_tag",
                 order: str = "trading_session", out: str = "split") -> DataFrame:
    """First floor(frac * n) rows of each series are 'train', the rest 'test'."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy(order)
    return (df.join(counts, group)
            .withColumn("_rn", F.row_number().over(w))
            .withColumn(out, F.when(F.col("_rn") <= F.floor(F.col("_n") * frac), "train")
                        .otherwise("test"))
            .drop("_rn", "_n"))


def standardize(df: DataFrame, cols, group: str = "asset_tag", fit_on: str | None = "split",
                fit_value: str = "train", suffix: str = "_z") -> DataFrame:
    """z = (x - mean) / population std per group, std 0 -> divide by 1.
    Statistics come from rows where ``fit_on == fit_value`` (train rows) or
    from all rows when ``fit_on`` is None."""
    src = df if fit_on is None else df.filter(F.col(fit_on) == fit_value)
    stats = src.groupBy(group).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                                   *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = df.join(stats, group, "left")
    scale = {c: F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in cols}
    return j.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}")) / scale[c] for c in cols})


def unstandardize(z: Column, mean: Column, std: Column) -> Column:
    return z * F.when(std == 0, F.lit(1.0)).otherwise(std) + mean


def lookback_sequences(df: DataFrame, cols, target: str, seq_len: int = FV.SEQ_LEN,
                       min_rows: int = FV.MIN_SEQ_ROWS, group: str = "asset_tag",
                       order: str = "trading_session", keep=(), block: int = SEQ_BLOCK) -> DataFrame:
    """For each row with ``seq_len`` earlier rows, the array of those
    rows' feature structs (oldest first) and the row's target, with the columns
    ``keep``.  Series with fewer than ``min_rows`` rows are skipped.

    Only numbering the rows takes a series as a whole.  The sequences are made
    in blocks of its rows: the last ``seq_len`` rows of a block go to the next
    one, too, so no task holds the sequences of a series."""
    block = max(block, seq_len)
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.select(group, order, F.col(target).alias("y"), F.struct(*[F.col(c) for c in cols]).alias("_f"), *keep)
    rows = (rows.join(counts, group).filter(F.col("_n") >= min_rows)
            .withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1))
    own = F.floor(F.col("_at") / block)
    rows = rows.withColumn("_block", F.explode(F.when(
        F.col("_at") % block >= block - seq_len, F.array(own, own + 1)).otherwise(F.array(own))))
    # a fixed count: short rows turn into long sequences, so merging partitions by their bytes leaves few tasks
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "_block")
    w = Window.partitionBy(group, "_block").orderBy("_at").rowsBetween(-seq_len, -1)
    return (rows.withColumn("seq", F.collect_list("_f").over(w))
            .filter((F.size("seq") == seq_len) & (F.col("_block") == own))
            .select(group, order, "y", "seq", *keep))


def error_metrics(df: DataFrame, actual: str, pred: str, by) -> DataFrame:
    """RMSE and MAE per group."""
    e = F.col(pred) - F.col(actual)
    return df.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.count(F.lit(1)).alias("n"))
