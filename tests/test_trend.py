"""Piecewise trends: planted changepoints, and the normal equations by numpy."""

import datetime as dt
import math

import numpy as np
import pytest

from sentibar.operators import trend as TR


def frame(spark, series):
    rows = [(a, dt.date(2019, 1, 1) + dt.timedelta(days=i), None if y is None else float(y))
            for a, ys in series.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "asset_tag string, trading_session date, close double")


def fitted(spark, series, **kw):
    out = {}
    for r in TR.trend_fit(frame(spark, series), **kw).collect():
        out.setdefault(r.asset_tag, {})[r.term] = r
    return out


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    ys = rng.normal(size=200).cumsum() + 50
    got = fitted(spark, {"A": ys})["A"]
    d = np.arange(200) + (dt.date(2019, 1, 1) - dt.date(1970, 1, 1)).days
    t = np.arange(200) / 199
    cols = [np.ones(200), t] + [np.maximum(t - 0.8 * j / 13, 0) for j in range(1, 13)]
    cols += [f(2 * math.pi * k / 365.25 * d) for k in (1, 2) for f in (np.sin, np.cos)]
    x = np.stack(cols, axis=1)
    pen = np.diag([0.0] * 2 + [0.01 * 200] * 12 + [0.0] * 4)
    b = np.linalg.solve(x.T @ x + pen, x.T @ ys)
    assert [got[n].coefficient for n in TR.term_names()] == pytest.approx(b.tolist(), rel=1e-6, abs=1e-6)
    assert got["t"].rmse == pytest.approx(math.sqrt(((ys - x @ b) ** 2).mean()), rel=1e-6)


def test_planted_changepoints_are_found(spark):
    t = np.arange(600) / 599
    up = 10 + 5 * t - 40 * np.maximum(t - 0.8 * 6 / 13, 0)
    wave = 3 * np.sin(2 * math.pi * (np.arange(600) + (dt.date(2019, 1, 1) - dt.date(1970, 1, 1)).days) / 365.25)
    got = fitted(spark, {"bend": up + wave, "line": 2 + 3 * t, "flat": [4.0] * 30, "one": [7.0], "gap": [None, 1.0, 2.0]},
                 penalty=1e-7)
    bend = {n: r.coefficient for n, r in got["bend"].items()}
    assert max((n for n in bend if n.startswith("hinge")), key=lambda n: abs(bend[n])) == "hinge_6"
    assert bend["hinge_6"] == pytest.approx(-40, rel=0.05) and bend["sin_1"] == pytest.approx(3, rel=0.05)
    assert got["bend"]["hinge_6"].at == pytest.approx(0.8 * 6 / 13)
    assert all(abs(r.coefficient) < 0.05 for n, r in got["line"].items() if n.startswith("hinge"))
    assert got["line"]["t"].coefficient == pytest.approx(3, abs=0.05)
    assert set(got) == {"bend", "line", "flat", "one", "gap"} and got["one"]["t"].n == 1
    assert all(math.isfinite(r.coefficient) for s in got.values() for r in s.values())
