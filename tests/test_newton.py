"""Score and information folds: against finite differences and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentibar.operators import newton as NW


def loglik(model, y, h0, th):
    """The recursion, written as a loop."""
    x, e, ll = None, 0.0, 0.0
    for v in y:
        if x is None:
            x = {"garch": h0, "tgarch": math.sqrt(h0), "egarch": math.log(h0)}[model]
        elif model == "garch":
            x = th[0] + th[1] * e * e + th[2] * x
        elif model == "tgarch":
            x = th[0] + th[1] * abs(e) + th[2] * (abs(e) if e < 0 else 0.0) + th[3] * x
        else:
            z = e / math.exp(x / 2)
            x = th[0] + th[1] * (abs(z) - math.sqrt(2 / math.pi)) + th[2] * z + th[3] * x
        level = {"garch": math.log(x) if x > 0 else math.nan, "tgarch": 2 * math.log(x) if x > 0 else math.nan}.get(model, x)
        ll -= 0.5 * (math.log(2 * math.pi) + level + v * v / math.exp(level))
        e = v
    return ll


def simulated(rng, n):
    h, out = 1.0, []
    for _ in range(n):
        out.append(rng.normal() * math.sqrt(h))
        h = 0.05 + 0.1 * out[-1] ** 2 + 0.85 * h
    return out


def series(spark, *ys):
    rows = [(f"s{i}", [float(v) for v in y], len(y), float(np.var(y, ddof=1)) if len(y) > 1 else None, 0.0)
            for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "asset_tag string, y array<double>, n long, h0 double, mu double")


AT = {"garch": [0.1, 0.08, 0.8], "tgarch": [0.1, 0.05, 0.08, 0.8], "egarch": [0.02, 0.1, -0.05, 0.9]}


@pytest.mark.parametrize("model", list(AT))
def test_score_equals_finite_differences(spark, model):
    y = simulated(np.random.default_rng(1), 150)
    th = AT[model]
    df = series(spark, y)
    v = df.select(NW.evaluate(model, F.col("y"), F.col("h0"), F.array(*[F.lit(x) for x in th])).alias("v")).first().v
    h0 = float(np.var(y, ddof=1))
    assert v.ll == pytest.approx(loglik(model, y, h0, th), rel=1e-10)
    for j, s in enumerate(v.s):
        up, down = list(th), list(th)
        up[j] += 1e-6
        down[j] -= 1e-6
        assert s == pytest.approx((loglik(model, y, h0, up) - loglik(model, y, h0, down)) / 2e-6, rel=1e-4, abs=1e-4)


def test_solve(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4, 4))
    a = a @ a.T + np.eye(4)
    b = rng.normal(size=4)
    tri = F.array(*[F.lit(float(a[i, j])) for i in range(4) for j in range(i + 1)])
    rhs = F.array(*[F.lit(float(x)) for x in b])
    got = spark.range(1).select(NW.solve(tri, rhs, 4, F.lit(0.1)).alias("x")).first().x
    assert got == pytest.approx(np.linalg.solve(a + 0.1 * np.diag(np.diag(a)), b).tolist())


@pytest.mark.parametrize("model", list(AT))
def test_fit_reaches_the_top(spark, model):
    y = simulated(np.random.default_rng(3), 700)
    odd = [[0.0] * 30, [1.0]]
    rows = NW.newton_fit(series(spark, y, *odd), model).collect()
    fit = {r.parameter: r for r in rows if r.asset_tag == "s0"}
    assert {r.asset_tag for r in rows} == {"s0", "s1", "s2"}
    assert all(r.estimate is None for r in rows if r.asset_tag != "s0")
    th = [fit[p].estimate for p in NW.NAMES[model]]
    h0 = float(np.var(y, ddof=1))
    best = fit["omega"].loglik
    assert best == pytest.approx(loglik(model, y, h0, th), rel=1e-9)
    assert all(r.std_error > 0 for r in fit.values())
    # no small move within the allowed region is better
    for j in range(len(th)):
        for d in (1e-3, -1e-3):
            near = list(th)
            near[j] += d
            if model == "garch" and (min(near) < 0 or near[1] + near[2] >= 1) or model == "tgarch" and min(near[1], near[1] + near[2]) < 0:
                continue
            value = loglik(model, y, h0, near)
            assert not value > best + 1e-3
    if model == "garch":
        assert abs(th[1] - 0.1) < 4 * fit["alpha"].std_error and abs(th[2] - 0.85) < 4 * fit["beta"].std_error


def plain_arma(y, phi, theta):
    """Gaussian likelihood from the full covariance matrix."""
    n = len(y)
    gamma = np.zeros(n)
    gamma[0] = (1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2)
    if n > 1:
        gamma[1] = phi * gamma[0] + theta
    for k in range(2, n):
        gamma[k] = phi * gamma[k - 1]
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    y = np.asarray(y)
    sigma2 = y @ np.linalg.solve(cov, y) / n
    return -0.5 * (n * (math.log(2 * math.pi * sigma2) + 1) + np.linalg.slogdet(cov)[1])


def test_exact_arma_likelihood_and_fit(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=401)
    y = [0.0]
    for t in range(1, 401):
        y.append(0.6 * y[-1] + e[t] + 0.3 * e[t - 1])
    y = y[1:]
    df = series(spark, y[:60], y, [0.0, 0.0])
    got = df.select("asset_tag", NW.arma_exact(F.col("y"), F.lit(0.5), F.lit(-0.3)).alias("v")).collect()
    assert got[0].v.ll == pytest.approx(plain_arma(y[:60], 0.5, -0.3), rel=1e-9)
    assert got[2].v.ll is None
    fit = {r.asset_tag: r for r in NW.arma_exact_fit(df).collect()}
    assert fit["s2"].loglik is None and fit["s2"].phi is None
    r = fit["s1"]
    assert r.loglik == pytest.approx(plain_arma(y, r.phi, r.theta), rel=1e-9)
    grid = max(plain_arma(y, a, b) for a in np.linspace(-0.9, 0.9, 7) for b in np.linspace(-0.9, 0.9, 7))
    assert r.loglik >= grid - 1e-6 and abs(r.phi - 0.6) < 0.2 and abs(r.theta - 0.3) < 0.2
