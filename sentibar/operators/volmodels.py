"""Time-series likelihood models as Spark jobs (H3-H8).

A likelihood at given parameters is a left fold over one ordered array per
series (``series_arrays``) with ``F.aggregate``: the recursion runs inside
the executor that holds the row, and arrays are bounded by the number of
sessions of one series.  Fitting is a multi-start pattern search: Spark
distributes (series x start block) rows, each searches from its own part of
a coarse grid, and an aggregate keeps the best per series.  A search step
evaluates a small grid around the best point in one numpy recursion
vectorised over the points; the grid widens while the best point lies on its
edge, so nothing confines it to the coarse box, and narrows otherwise.

Conventions (documented deviations from a numerical optimiser):
* GARCH-family start value h_1 = sample variance of the residuals;
* the intercept is ``level`` times the one that variance targeting gives;
  ``level`` is searched like the other parameters;
* the mean is the sample mean of the (scaled) returns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LN_2PI = math.log(2 * math.pi)
SQRT_2_OVER_PI = math.sqrt(2 / math.pi)


def residual_series(df: DataFrame, ret: str = "log_return_1d", scale: float = 100.0,
                    group: str = "asset_tag", order: str = "trading_session") -> DataFrame:
    """Per-row residual e = scale * r - mean(scale * r) of its series (H8)."""
    x = df.filter(F.col(ret).isNotNull()).select(group, order, (F.col(ret) * scale).alias("_x"))
    mu = x.groupBy(group).agg(F.avg("_x").alias("mu"))
    return x.join(mu, group).select(group, order, "mu", (F.col("_x") - F.col("mu")).alias("e"))


def series_arrays(resid: DataFrame, value: str = "e", group: str = "asset_tag",
                  order: str = "trading_session") -> DataFrame:
    """One row per series: ordered values, count, sample variance, mean."""
    return resid.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).alias("v"))))
        .alias("_s"),
        F.count(F.lit(1)).alias("n"), F.var_samp(value).alias("h0"), F.first("mu").alias("mu")
    ).select(group, F.transform("_s", lambda s: s["v"]).alias("y"), "n", "h0", "mu")


# ------------------------------------------------------------------ filters
def _acc(h, e2, ll, flag) -> Column:
    return F.struct(h.cast("double").alias("h"), e2.cast("double").alias("e2"),
                    ll.cast("double").alias("ll"), flag.alias("first"))


def garch_loglik(y: Column, h0: Column, omega: Column, alpha: Column, beta: Column) -> Column:
    """GARCH(1,1) Gaussian log-likelihood of residuals ``y`` (mean removed):
    h_1 = h0, h_t = omega + alpha e_{t-1}^2 + beta h_{t-1}."""
    init = _acc(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(True))

    def step(acc, e):
        h = F.when(acc["first"], h0).otherwise(omega + alpha * acc["e2"] + beta * acc["h"])
        return _acc(h, e * e, acc["ll"] + F.lit(LN_2PI) + F.ln(h) + e * e / h, F.lit(False))

    return F.aggregate(y, init, step, lambda acc: F.lit(-0.5) * acc["ll"])


def egarch_loglik(y: Column, h0: Column, omega: Column, alpha: Column, gamma: Column,
                  beta: Column) -> Column:
    """EGARCH(1,1,1): ln h_t = omega + alpha(|z| - sqrt(2/pi)) + gamma z + beta ln h_{t-1}."""
    init = _acc(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(True))

    def step(acc, e):
        z = acc["e2"]  # holds the previous standardized residual
        lnh = F.when(acc["first"], F.ln(h0)).otherwise(
            omega + alpha * (F.abs(z) - F.lit(SQRT_2_OVER_PI)) + gamma * z + beta * F.ln(acc["h"]))
        h = F.exp(lnh)
        return _acc(h, e / F.sqrt(h), acc["ll"] + F.lit(LN_2PI) + lnh + e * e / h, F.lit(False))

    return F.aggregate(y, init, step, lambda acc: F.lit(-0.5) * acc["ll"])


def tgarch_loglik(y: Column, h0: Column, omega: Column, alpha: Column, gamma: Column,
                  beta: Column) -> Column:
    """Threshold model of power 1 (on sigma): sigma_t = omega +
    (alpha + gamma 1[e_{t-1} < 0]) |e_{t-1}| + beta sigma_{t-1}."""
    init = _acc(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(True))

    def step(acc, e):
        prev = acc["e2"]  # holds the previous residual
        sig = F.when(acc["first"], F.sqrt(h0)).otherwise(
            omega + (alpha + F.when(prev < 0, gamma).otherwise(F.lit(0.0))) * F.abs(prev)
            + beta * acc["h"])
        h = sig * sig
        return _acc(sig, e, acc["ll"] + F.lit(LN_2PI) + F.ln(h) + e * e / h, F.lit(False))

    return F.aggregate(y, init, step, lambda acc: F.lit(-0.5) * acc["ll"])


def arma_sse(y: Column, mu: Column, phi: Column, theta: Column) -> Column:
    """ARMA(1,1) with constant c = mu (1 - phi): conditional sum of squared
    innovations, y_0 = mu and e_0 = 0."""
    init = F.struct(mu.cast("double").alias("yp"), F.lit(0.0).alias("ep"), F.lit(0.0).alias("s"))

    def step(acc, v):
        e = v - mu * (1 - phi) - phi * acc["yp"] - theta * acc["ep"]
        return F.struct(v.alias("yp"), e.alias("ep"), (acc["s"] + e * e).alias("s"))

    return F.aggregate(y, init, step, lambda acc: acc["s"])


# --------------------------------------------------------------- grid fits
def _linspace(lo: float, hi: float, k: int):
    return [lo + (hi - lo) * i / (k - 1) for i in range(k)]


# Coarse grids and parameter counts k (the mean counts as a parameter; the
# intercept of the GARCH family is free through ``level``).
GRID_SPECS = {
    "garch": ({"alpha": _linspace(0.01, 0.3, 10), "beta": _linspace(0.5, 0.98, 13), "level": [0.7, 1.0, 1.3]}, 4),
    "egarch": ({"alpha": _linspace(0.0, 0.4, 6), "gamma": _linspace(-0.2, 0.2, 5),
                "beta": _linspace(0.7, 0.99, 8), "level": [0.7, 1.0, 1.3]}, 5),
    "tgarch": ({"alpha": _linspace(0.0, 0.2, 6), "gamma": _linspace(0.0, 0.2, 5),
                "beta": _linspace(0.7, 0.98, 8), "level": [0.7, 1.0, 1.3]}, 5),
    "arma": ({"phi": _linspace(-0.9, 0.9, 19), "theta": _linspace(-0.9, 0.9, 19)}, 4),
}


def np_loglik(model: str, y, P: dict):
    """Log-likelihood of one series for a whole vector of parameter points
    at once (same recursions and conventions as the column folds above)."""
    import numpy as np

    y = np.asarray(y, dtype=float)
    n = len(y)
    h0 = float(np.var(y, ddof=1)) if n > 1 else float("nan")
    g = len(next(iter(P.values())))
    ll = np.zeros(g)
    with np.errstate(all="ignore"):
        if model == "garch":
            a, b, lv = P["alpha"], P["beta"], P["level"]
            valid = (a >= 0) & (b >= 0) & (a + b < 1) & (lv > 0)
            om = lv * h0 * (1 - a - b)
            h = np.full(g, h0)
            for t in range(n):
                if t > 0:
                    h = om + a * y[t - 1] ** 2 + b * h
                ll += LN_2PI + np.log(h) + y[t] ** 2 / h
            out = -0.5 * ll
        elif model == "egarch":
            a, gm, b, lv = P["alpha"], P["gamma"], P["beta"], P["level"]
            valid = (np.abs(b) < 1) & (lv > 0)
            om = (1 - b) * np.log(lv * h0)
            lnh = np.full(g, np.log(h0))
            z = np.zeros(g)
            for t in range(n):
                if t > 0:
                    lnh = om + a * (np.abs(z) - SQRT_2_OVER_PI) + gm * z + b * lnh
                h = np.exp(lnh)
                z = y[t] / np.sqrt(h)
                ll += LN_2PI + lnh + y[t] ** 2 / h
            out = -0.5 * ll
        elif model == "tgarch":
            a, gm, b, lv = P["alpha"], P["gamma"], P["beta"], P["level"]
            persist = b + (a + gm / 2) * SQRT_2_OVER_PI
            valid = (a >= 0) & (gm >= 0) & (b >= 0) & (persist < 1) & (lv > 0)
            om = lv * np.sqrt(h0) * (1 - persist)
            sig = np.full(g, np.sqrt(h0))
            for t in range(n):
                if t > 0:
                    prev = y[t - 1]
                    sig = om + (a + (gm if prev < 0 else 0.0)) * abs(prev) + b * sig
                h = sig * sig
                ll += LN_2PI + np.log(h) + y[t] ** 2 / h
            out = -0.5 * ll
        elif model == "arma":
            phi, theta = P["phi"], P["theta"]
            valid = (np.abs(phi) < 1) & (np.abs(theta) < 1)
            yp, ep, sse = 0.0, np.zeros(g), np.zeros(g)
            for t in range(n):
                e = y[t] - phi * yp - theta * ep
                sse += e * e
                yp, ep = y[t], e
            out = -n / 2 * (LN_2PI + np.log(sse / n) + 1)
        else:
            raise ValueError(model)
    return np.where(valid & np.isfinite(out), out, np.nan)


def _points(axes: dict) -> dict:
    import numpy as np

    mesh = np.meshgrid(*[np.asarray(v, dtype=float) for v in axes.values()], indexing="ij")
    return {n: m.ravel() for n, m in zip(axes, mesh)}


def fit_series(y, model: str, steps: int = 40, tol: float = 1e-5, block: int | None = None):
    """Pattern search from the best coarse point (of one ``block``: one value of
    the first parameter).  Each step tries a 3-point grid per parameter around
    the best; a parameter's step doubles when the best moved to the edge and
    halves when it stayed, until every step is below ``tol``."""
    import numpy as np

    grid, k = GRID_SPECS[model]
    names = list(grid)
    axes = dict(grid)
    if block is not None:
        axes[names[0]] = [grid[names[0]][block]]
    width = {n: (max(v) - min(v)) / (len(v) - 1) / 2 for n, v in grid.items()}
    best, best_ll = None, -np.inf
    pts = _points(axes)
    for _ in range(steps + 1):
        ll = np_loglik(model, y, pts)
        moved = {n: 0.0 for n in names}
        if not np.all(np.isnan(ll)):
            i = int(np.nanargmax(ll))
            if ll[i] > best_ll:
                new = {n: float(pts[n][i]) for n in names}
                if best is not None:
                    moved = {n: abs(new[n] - best[n]) for n in names}
                    width = {n: w * (2.0 if moved[n] else 0.5) for n, w in width.items()}
                best, best_ll = new, float(ll[i])
            elif best is not None:
                width = {n: w * 0.5 for n, w in width.items()}
        if best is None or max(width.values()) < tol:
            break
        pts = _points({n: (best[n] - width[n], best[n], best[n] + width[n]) for n in names})
    return best, best_ll, k


def fit_grid(resid: DataFrame, model: str, group: str = "asset_tag",
             order: str = "trading_session", value: str = "e") -> DataFrame:
    """Fit ``model`` in {garch, egarch, tgarch, arma} per series.

    One row per (series, start block) carries the series (its length is the
    number of sessions); rows are dealt over the cluster, each runs its own
    search, and ``max_by`` keeps the best of each series.  A series without a
    valid starting point (one row, or zero variance) keeps its row with null
    parameters and log-likelihood."""
    import pandas as pd

    grid, k = GRID_SPECS[model]
    names = list(grid)
    blocks = len(grid[names[0]])
    clean = resid.filter(F.col(value).isNotNull())
    mu = F.lit(0.0).alias("mu")
    arrays = series_arrays(clean.select(group, order, value, mu), value, group, order).select(group, "y", "n")
    starts = (arrays.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
              .repartition(F.col(group), F.col("block")))
    schema = ", ".join([f"`{group}` string", "n long", *[f"{n} double" for n in names], "loglik double"])

    def search(frames):
        for pdf in frames:
            rows = []
            for g, y, n, block in pdf[[group, "y", "n", "block"]].itertuples(index=False):
                best, ll, _ = fit_series(y, model, block=block)
                if best is not None:
                    rows.append((g, n, *[best[p] for p in names], ll))
            yield pd.DataFrame(rows, columns=[group, "n", *names, "loglik"])

    found = starts.select(group, "y", "n", "block").mapInPandas(search, schema)
    best = found.groupBy(group).agg(
        F.max_by(F.struct(*names, "loglik"), F.struct("loglik", *names)).alias("b")).select(
        F.col(group).alias("_of"), "b.*")
    series = resid.groupBy(group).agg(F.count(value).alias("n"))
    best = series.join(best, F.col(group).eqNullSafe(F.col("_of")), "left")
    aic, bic = -2 * F.col("loglik") + 2 * k, -2 * F.col("loglik") + k * F.ln(F.col("n").cast("double"))
    return best.select(group, F.lit(model).alias("model"), *names, "loglik", F.lit(k).alias("k"), "n",
                       aic.alias("aic"), bic.alias("bic"))
