"""Known-answer tests for the statistics and likelihood operators, and
plan properties (partitioning independence, alignment, split)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentibar.operators import stats as ST
from sentibar.operators import volmodels as VM

D = dt.date


def _frame(spark, cols: dict, group="X"):
    n = len(next(iter(cols.values())))
    rows = [(group, D(2000, 1, 1) + dt.timedelta(days=i), *[float(cols[c][i]) for c in cols])
            for i in range(n)]
    schema = "asset_tag string, trading_session date, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


def test_market_and_two_factor_match_lstsq(spark):
    rng = np.random.default_rng(1)
    x1, x2 = rng.normal(size=300), rng.normal(size=300)
    y = 0.01 + 1.5 * x1 - 0.7 * x2 + rng.normal(scale=0.5, size=300)
    df = _frame(spark, {"y": y, "x1": x1, "x2": x2})
    b = np.linalg.lstsq(np.c_[np.ones(300), x1], y, rcond=None)[0]
    m = ST.market_model(df, "y", "x1").collect()[0]
    assert m.beta == pytest.approx(b[1]) and m.alpha == pytest.approx(b[0])
    ssr = np.sum((y - np.c_[np.ones(300), x1] @ b) ** 2)
    ll = -300 / 2 * (math.log(2 * math.pi) + math.log(ssr / 300) + 1)
    assert m.aic == pytest.approx(-2 * ll + 4) and m.bic == pytest.approx(-2 * ll + 2 * math.log(300))
    b2 = np.linalg.lstsq(np.c_[np.ones(300), x1, x2], y, rcond=None)[0]
    t = ST.two_factor(df, "y", "x1", "x2").collect()[0]
    assert (t.beta_market, t.beta_factor, t.k) == (pytest.approx(b2[1]), pytest.approx(b2[2]), 3)


def test_collinear_factor_falls_back_to_one_factor(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = 2 * x + rng.normal(size=200)
    df = _frame(spark, {"y": y, "x1": x, "x2": x})
    t = ST.two_factor(df, "y", "x1", "x2").collect()[0]
    m = ST.market_model(df, "y", "x1").collect()[0]
    assert t.collinear and t.k == 2
    assert t.aic == pytest.approx(m.aic) and t.bic == pytest.approx(m.bic)


def _simulate_garch(n, omega, alpha, beta, seed=3):
    rng = np.random.default_rng(seed)
    h = omega / (1 - alpha - beta)
    e = np.zeros(n)
    for t in range(n):
        e[t] = math.sqrt(h) * rng.normal()
        h = omega + alpha * e[t] ** 2 + beta * h
    return e


def test_garch_loglik_matches_numpy(spark):
    e = _simulate_garch(500, 0.1, 0.1, 0.8)
    df = _frame(spark, {"log_return_1d": e / 100})
    s = VM.series_arrays(VM.residual_series(df)).collect()[0]
    y = np.array(s.y)
    h0 = np.var(y, ddof=1)
    a, b = 0.1, 0.8
    om = h0 * (1 - a - b)
    h, ll = h0, 0.0
    for t in range(len(y)):
        if t > 0:
            h = om + a * y[t - 1] ** 2 + b * h
        ll += math.log(2 * math.pi) + math.log(h) + y[t] ** 2 / h
    got = VM.series_arrays(VM.residual_series(df)).select(
        VM.garch_loglik(F.col("y"), F.col("h0"), F.col("h0") * (1 - a - b), F.lit(a), F.lit(b))
        .alias("ll")).collect()[0].ll
    assert got == pytest.approx(-0.5 * ll, rel=1e-9)


def test_garch_grid_recovers_persistence(spark):
    e = _simulate_garch(3000, 0.05, 0.12, 0.83)
    df = _frame(spark, {"log_return_1d": e / 100})
    fit = VM.fit_grid(VM.residual_series(df), "garch").collect()[0]
    assert fit.alpha == pytest.approx(0.12, abs=0.06)
    assert fit.beta == pytest.approx(0.83, abs=0.08)
    assert fit.k == 4


def test_arma_grid_recovers_ar(spark):
    rng = np.random.default_rng(5)
    n, phi = 2000, 0.6
    y = np.zeros(n)
    eps = rng.normal(size=n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + eps[t]
    df = _frame(spark, {"log_return_1d": y})
    fit = VM.fit_grid(VM.residual_series(df, scale=1.0), "arma").collect()[0]
    assert fit.phi == pytest.approx(phi, abs=0.1)
    assert fit.theta == pytest.approx(0.0, abs=0.15)


def test_split_is_chronological_and_disjoint(spark):
    df = _frame(spark, {"v": list(range(50))})
    s = ST.chrono_split(df).collect()
    train = [r.trading_session for r in s if r.split == "train"]
    test = [r.trading_session for r in s if r.split == "test"]
    assert len(train) == 40 and max(train) < min(test)


def test_result_independent_of_partitioning(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    from sentibar.operators import features as FE
    from sentibar.sources import fixtures as FX
    from sentibar.sources.tables import Tables
    t = Tables(spark, SF_SMALL)
    base = FE.build_features(FX.bars_from_lineitem(t.lineitem), FX.news_from_orders(t.orders))
    shuffled = FE.build_features(FX.bars_from_lineitem(t.lineitem.repartition(7)),
                                 FX.news_from_orders(t.orders.repartition(3)))
    key = ["asset_tag", "trading_session"]
    a = base.select(*key, F.round("realized_vol_22d", 9).alias("v")).orderBy(*key).collect()
    b = shuffled.select(*key, F.round("realized_vol_22d", 9).alias("v")).orderBy(*key).collect()
    assert a == b


def test_no_article_after_its_session_close(spark):
    from conftest import SF_SMALL
    from sentibar.operators import calendar as CA
    from sentibar.sources import fixtures as FX
    from sentibar.sources.tables import Tables
    t = Tables(spark, SF_SMALL)
    cal = FX.session_calendar(spark)
    a = CA.align_to_sessions(FX.news_from_orders(t.orders).select("news_id", "time"), cal)
    j = a.join(cal, a.trading_session == cal.session_date)
    assert j.filter(F.col("time") > F.col("close_ts")).count() == 0


@pytest.mark.parametrize("model,params", [
    ("garch", {"alpha": 0.1, "beta": 0.8, "level": 1.0}),
    ("egarch", {"alpha": 0.2, "gamma": -0.1, "beta": 0.9, "level": 1.0}),
    ("tgarch", {"alpha": 0.05, "gamma": 0.1, "beta": 0.85, "level": 1.0}),
])
def test_numpy_and_column_folds_agree(spark, model, params):
    e = _simulate_garch(400, 0.1, 0.1, 0.8, seed=9)
    df = _frame(spark, {"log_return_1d": e / 100})
    s = VM.series_arrays(VM.residual_series(df))
    row = s.collect()[0]
    want = VM.np_loglik(model, np.array(row.y), {k: np.array([v]) for k, v in params.items()})[0]
    y, h0 = F.col("y"), F.col("h0")
    lit = {k: F.lit(v) for k, v in params.items()}
    if model == "garch":
        col = VM.garch_loglik(y, h0, h0 * (1 - lit["alpha"] - lit["beta"]), lit["alpha"], lit["beta"])
    elif model == "egarch":
        col = VM.egarch_loglik(y, h0, (1 - lit["beta"]) * F.ln(h0), lit["alpha"], lit["gamma"], lit["beta"])
    else:
        persist = lit["beta"] + (lit["alpha"] + lit["gamma"] / 2) * F.lit(VM.SQRT_2_OVER_PI)
        col = VM.tgarch_loglik(y, h0, F.sqrt(h0) * (1 - persist), lit["alpha"], lit["gamma"], lit["beta"])
    got = s.select(col.alias("ll")).collect()[0].ll
    assert got == pytest.approx(want, rel=1e-9)


def test_constant_regressors_keep_every_group(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    y = 0.5 + 2 * x + rng.normal(scale=0.1, size=60)
    zero = np.zeros(60)
    df = (_frame(spark, {"y": y, "x1": x, "x2": zero}, "A")
          .unionByName(_frame(spark, {"y": y, "x1": zero, "x2": x}, "B"))
          .unionByName(_frame(spark, {"y": y, "x1": zero, "x2": zero}, "C")))
    m = {r.asset_tag: r for r in ST.market_model(df, "y", "x1").collect()}
    assert m["A"].beta == pytest.approx(2, abs=0.1)
    assert m["B"].beta == 0 and m["B"].alpha == pytest.approx(y.mean())
    t = {r.asset_tag: r for r in ST.two_factor(df, "y", "x1", "x2").collect()}
    assert [t[a].k for a in "ABC"] == [2, 2, 1]
    assert t["A"].beta_market == pytest.approx(t["B"].beta_factor) and t["A"].aic == pytest.approx(t["B"].aic)
    assert (t["C"].beta_market, t["C"].beta_factor) == (0, 0)


def test_fits_leave_the_coarse_grid(spark):
    rng = np.random.default_rng(6)
    n = 1500
    y, e = np.zeros(n), rng.normal(size=n)
    for t in range(1, n):
        y[t] = 0.985 * y[t - 1] + e[t] + 0.1 * e[t - 1]
    r = _simulate_garch(n, 0.2, 0.6, 0.2)
    df = _frame(spark, {"log_return_1d": y}, "A").unionByName(_frame(spark, {"log_return_1d": r}, "G"))
    resid = VM.residual_series(df, scale=1.0)
    true = {"arma": {"phi": [0.985], "theta": [0.1]}, "garch": {"alpha": [0.6], "beta": [0.2]}}
    for model, asset in (("arma", "A"), ("garch", "G")):
        fit = {x.asset_tag: x for x in VM.fit_grid(resid, model).collect()}[asset]
        s = np.array([x.e for x in resid.filter(F.col("asset_tag") == asset).orderBy("trading_session").collect()])
        point = {k: np.array(v) for k, v in true[model].items()}
        if model == "garch":
            point["level"] = np.array([0.2 / (np.var(s, ddof=1) * 0.2)])
        assert fit.loglik >= VM.np_loglik(model, s, point)[0]


def test_exact_attribution_adds_up(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from sentibar.operators import ml as ML
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3))
    df = _frame(spark, {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": x @ [1.0, -2.0, 0.5] + 3})
    frame = df.withColumn("split", F.when(F.col("trading_session") < D(2000, 2, 1), "train").otherwise("test"))
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame)
    model = LinearRegression(labelCol="y").fit(data)
    got = ML.shapley_attribution(frame, model, ["a", "b", "c"], "X").collect()
    mean = x[:31].mean(0)
    coef = dict(zip("abc", model.coefficients))
    for r in got:                       # a linear model's values are coefficient x deviation
        assert r.shap == pytest.approx(coef[r.feature] * (r.value - mean["abc".index(r.feature)]), abs=1e-9)


def test_density_of_close_values_is_not_binned(spark):
    from sentibar.operators import quality as QU
    v = 0.5 + np.arange(200) * 1e-6
    df = _frame(spark, {"s": v})
    got = sorted((r.g, r.x, r.density) for r in QU.kde_curve(df, "asset_tag", ["s"], grid=50).collect())
    h = v.std(ddof=1) * 200 ** -0.2
    for _, x, d in got[::7]:
        assert d == pytest.approx(np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (200 * h * math.sqrt(2 * math.pi)), rel=1e-9)
    assert got[0][1] == pytest.approx(v[0]) and got[-1][1] == pytest.approx(v[-1])


def test_dependence_has_one_row_per_hold_out_row(spark):
    from sentibar.plans import load_all
    from sentibar.session import prepare_session

    prepare_session(spark)
    rows = load_all()["attribution_rows"].run(spark, "/root/testdata/sf0.001")
    key = ["asset_tag", "trading_session"]
    got = load_all()["dependence"].run(spark, "/root/testdata/sf0.001").collect()
    want = rows.filter("feature = 'gemma_dispersion'").collect()
    assert len(got) == rows.select(*key).distinct().count() > 0
    assert sorted(map(tuple, got)) == sorted((r.asset_tag, r.trading_session, r.value, r.shap) for r in want)


@pytest.mark.parametrize("model", ["garch", "egarch", "tgarch", "arma"])
def test_series_without_a_start_keep_their_row(spark, model):
    y = np.random.default_rng(9).normal(size=40)
    df = (_frame(spark, {"log_return_1d": y}, "A").unionByName(_frame(spark, {"log_return_1d": np.zeros(40)}, "Z"))
          .unionByName(_frame(spark, {"log_return_1d": y[:1]}, "O")))
    got = {r.asset_tag: r for r in VM.fit_grid(VM.residual_series(df), model).collect()}
    assert {a: r.n for a, r in got.items()} == {"A": 40, "Z": 40, "O": 1}
    assert got["A"].loglik is not None and got["A"].aic is not None
    names = list(VM.GRID_SPECS[model][0])
    assert all(got[a][c] is None for a in "ZO" for c in [*names, "loglik", "aic", "bic"])
