"""Maximum likelihood with standard errors for the volatility family (H4-H7)
and the exact ARMA(1,1) likelihood (H3), as folds over a series' ordered array.

Score and information.  With ``L_t = ln h_t`` a Gaussian log-likelihood has the
score ``sum(0.5 (e_t^2 / h_t - 1) dL_t)`` and the expected information
``sum(0.5 dL_t dL_t')``, and every model of the family carries its variance by
a recursion ``x_t = c_t . theta`` whose gradient follows the same recursion.
One fold therefore carries the state, its gradient, the likelihood, the score
and the information.

Newton (Fisher scoring) steps.  An outer fold over step numbers proposes
``theta + (I + damp diag I)^-1 s``; the inner fold evaluates the proposal; it is
kept if the likelihood rises, else the damping grows.  Both folds are one
column, so all series are fitted in one job, each in the task that holds its
array (one daily series, as in :mod:`volmodels`).  Standard errors are the
roots of the diagonal of the inverse information at the last step.

Exact ARMA.  The one-step predictions of an ARMA(1,1) from its stationary start
follow the innovations recursion (the Kalman filter of its state space):
``r_1 = (1 + 2 phi theta + theta^2) / (1 - phi^2)``, ``r_t = 1 + theta^2 -
theta^2 / r_(t-1)``; the innovation variance is concentrated out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .volmodels import LN_2PI, SQRT_2_OVER_PI

STEPS = 60
NAMES = {"garch": ["omega", "alpha", "beta"], "tgarch": ["omega", "alpha", "gamma", "beta"],
         "egarch": ["omega", "alpha", "gamma", "beta"]}


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def start(model: str, h0: Column) -> Column:
    """First parameters: persistent, at the sample variance."""
    first = {"garch": [h0 * 0.05, F.lit(0.05), F.lit(0.9)],
             "tgarch": [F.sqrt(h0) * 0.07, F.lit(0.05), F.lit(0.05), F.lit(0.85)],
             "egarch": [F.ln(h0) * 0.1, F.lit(0.1), F.lit(0.0), F.lit(0.9)]}
    return F.array(*[c.cast("double") for c in first[model]])


def allowed(model: str, th: Column) -> Column:
    """Where the model has a positive, finite variance."""
    p = [F.get(th, F.lit(i)) for i in range(len(NAMES[model]))]
    if model == "garch":
        return (p[0] > 0) & (p[1] >= 0) & (p[2] >= 0) & (p[1] + p[2] < 1)
    if model == "tgarch":
        return (p[0] > 0) & (p[1] >= 0) & (p[1] + p[2] >= 0) & (p[3] >= 0) & (p[3] < 1)
    return F.abs(p[3]) < 1


def first_x(model: str, h0: Column) -> Column:
    return {"garch": h0, "tgarch": F.sqrt(h0), "egarch": F.ln(h0)}[model]


def inputs(model: str, x: Column, e: Column) -> Column:
    """``c_t``: what the parameters multiply, from the last state and residual."""
    if model == "garch":
        return F.array(F.lit(1.0), e * e, x)
    if model == "tgarch":
        size = F.abs(e)
        return F.array(F.lit(1.0), size, F.when(e < 0, size).otherwise(0.0), x)
    z = e * F.exp(-x / 2)
    return F.array(F.lit(1.0), F.abs(z) - SQRT_2_OVER_PI, z, x)


def carry(model: str, th: Column, x: Column, e: Column) -> Column:
    """How the last state's gradient enters the next one."""
    if model == "egarch":   # z depends on the state, too
        z = e * F.exp(-x / 2)
        return F.get(th, F.lit(3)) - 0.5 * (F.get(th, F.lit(1)) * F.abs(z) + F.get(th, F.lit(2)) * z)
    return F.get(th, F.lit(len(NAMES[model]) - 1))


def log_variance(model: str, x: Column, dx: Column) -> tuple[Column, Column]:
    """``L`` and its gradient from the state and its gradient."""
    if model == "garch":
        return F.ln(x), F.transform(dx, lambda d: F.try_divide(d, x))
    if model == "tgarch":
        return 2 * F.ln(x), F.transform(dx, lambda d: F.try_divide(2 * d, x))
    return x, dx


def evaluate(model: str, y: Column, h0: Column, th: Column) -> Column:
    """``struct(ll, s, i)``: log-likelihood, score and information (rows of the
    lower triangle) at ``th``; ``ll`` is null where the variance is not positive."""
    p = len(NAMES[model])
    zero, tri = F.array(*[F.lit(0.0)] * p), p * (p + 1) // 2
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    init = F.struct(F.lit(None).cast("double").alias("x"), zero.alias("d"), F.lit(0.0).alias("e"),
                    F.lit(0.0).alias("ll"), zero.alias("s"), F.array(*[F.lit(0.0)] * tri).alias("i"))

    def step(acc, e):
        first = acc["x"].isNull()

        def with_state(m):
            level, grad = log_variance(model, m["x"], m["d"])

            def with_level(v):
                ratio = e * e * F.exp(-v["level"])
                return F.struct(
                    m["x"].alias("x"), m["d"].alias("d"), e.cast("double").alias("e"),
                    (acc["ll"] - 0.5 * (LN_2PI + v["level"] + ratio)).alias("ll"),
                    F.zip_with(acc["s"], v["g"], lambda s, g: s + 0.5 * (ratio - 1) * g).alias("s"),
                    F.zip_with(acc["i"], F.array(*[F.get(v["g"], F.lit(i)) * F.get(v["g"], F.lit(j))
                                                   for i, j in pairs]), lambda s, g: s + 0.5 * g).alias("i"))

            return let(F.struct(level.alias("level"), grad.alias("g")), with_level)

        def next_state(c):
            k = carry(model, th, acc["x"], acc["e"])
            return F.struct(dot(c, th).alias("x"), F.zip_with(c, acc["d"], lambda a, d: a + k * d).alias("d"))

        moved = let(inputs(model, acc["x"], acc["e"]), next_state)
        state = F.when(first, F.struct(first_x(model, h0).cast("double").alias("x"), zero.alias("d"))).otherwise(moved)
        return let(state, with_state)

    out = F.aggregate(y, init, step)
    return let(out, lambda o: F.struct(F.when(~F.isnan(o["ll"]), o["ll"]).alias("ll"), o["s"].alias("s"),
                                       o["i"].alias("i")))


def solve(tri: Column, rhs: Column, p: int, damp: Column) -> Column:
    """``(I + damp diag I)^-1 rhs``, by Gauss-Jordan elimination of the symmetric
    matrix whose lower triangle is ``tri``."""
    def entry(i, j):
        a, b = max(i, j), min(i, j)
        value = F.get(tri, F.lit(a * (a + 1) // 2 + b))
        return value * (1 + damp) if i == j else value

    rows = F.array(*[F.array(*[entry(i, j) for j in range(p)], F.get(rhs, F.lit(i))) for i in range(p)])

    def eliminate(k):
        def rest(m, q):   # q is the pivot row
            return F.transform(m, lambda r, i: F.when(i == k, F.transform(
                q, lambda v: F.try_divide(v, F.get(q, F.lit(k))))).otherwise(F.zip_with(
                    r, q, lambda a, b: a - F.try_divide(F.get(r, F.lit(k)) * b, F.get(q, F.lit(k))))))
        return lambda m: let(F.get(m, F.lit(k)), lambda q: rest(m, q))

    for k in range(p):
        rows = let(rows, eliminate(k))
    return F.transform(rows, lambda r: F.get(r, F.lit(p)))


def one_step(model: str, y: Column, h0: Column, th: Column, damp: Column | float = 0.0) -> Column:
    """``struct(ll, s, i, to)``: the evaluation at ``th`` and the Fisher-scoring step."""
    damp = damp if isinstance(damp, Column) else F.lit(float(damp))
    p = len(NAMES[model])
    return let(evaluate(model, y, h0, th), lambda v: F.struct(
        v["ll"].alias("ll"), v["s"].alias("s"), v["i"].alias("i"),
        F.zip_with(th, solve(v["i"], v["s"], p, damp), lambda a, b: a + b).alias("to")))


def newton_fit(series: DataFrame, model: str, group: str = "asset_tag", steps: int = STEPS) -> DataFrame:
    """``(group, parameter, estimate, std_error, loglik, aic, bic, n)`` for every
    series of ``volmodels.series_arrays``.  A series without a start (no spread,
    one value) keeps its rows with nulls."""
    y, h0 = F.col("y"), F.col("h0")
    p = len(NAMES[model])

    def state(th, v, damp):
        return F.struct(th.alias("th"), v["ll"].alias("ll"), v["s"].alias("s"), v["i"].alias("i"),
                        damp.cast("double").alias("damp"))

    begin = let(start(model, h0), lambda th: state(th, evaluate(model, y, h0, th), F.lit(0.01)))

    def move(acc, _):
        to = F.zip_with(acc["th"], solve(acc["i"], acc["s"], p, acc["damp"]), lambda a, b: a + b)

        def judge(th):
            seen = F.when(allowed(model, th), evaluate(model, y, h0, th))
            return let(seen, lambda v: F.when(v["ll"] > acc["ll"], state(th, v, acc["damp"] / 4))
                       .otherwise(state(acc["th"], acc, F.least(acc["damp"] * 8, F.lit(1e9)))))

        return let(to, judge)

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, move)
    unit = [F.array(*[F.lit(float(i == j)) for j in range(p)]) for i in range(p)]
    done = series.where(F.size("y") > 0).select(group, "n", fit.alias("f"))
    errors = F.array(*[F.sqrt(F.get(solve(F.col("f.i"), unit[i], p, F.lit(0.0)), F.lit(i))) for i in range(p)])
    done = done.select(group, "n", "f", errors.alias("se"))
    rows = F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in NAMES[model]]).alias("a"),
                                  F.col("f.th").alias("b"), F.col("se").alias("c"))).alias("r")
    k, ok = p + 1, F.col("f.ll").isNotNull()   # the mean is a parameter, too
    return done.select(group, "n", F.col("f.ll").alias("loglik"), ok.alias("ok"), rows).select(
        group, F.col("r.a").alias("parameter"), F.when(F.col("ok"), F.col("r.b")).alias("estimate"),
        F.when(F.col("ok") & ~F.isnan(F.col("r.c")), F.col("r.c")).alias("std_error"), "loglik",
        (2 * k - 2 * F.col("loglik")).alias("aic"), (k * F.ln("n") - 2 * F.col("loglik")).alias("bic"), "n")


# ----------------------------------------------------------------- exact ARMA
def arma_exact(y: Column, phi: Column, theta: Column) -> Column:
    """``struct(ll, sigma2)``: exact Gaussian log-likelihood of an ARMA(1,1)
    around zero, innovation variance concentrated out."""
    init = F.struct(F.lit(0.0).alias("hat"), F.lit(None).cast("double").alias("r"), F.lit(0.0).alias("ss"),
                    F.lit(0.0).alias("lr"), F.lit(0.0).alias("n"))

    def step(acc, v):
        r = F.when(acc["r"].isNull(), (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)).otherwise(
            1 + theta * theta - theta * theta / acc["r"])
        return let(F.struct(r.cast("double").alias("r"), (v - acc["hat"]).cast("double").alias("v")), lambda m: F.struct(
            (phi * v + theta * m["v"] / m["r"]).cast("double").alias("hat"), m["r"].alias("r"),
            (acc["ss"] + m["v"] * m["v"] / m["r"]).alias("ss"), (acc["lr"] + F.ln(m["r"])).alias("lr"),
            (acc["n"] + 1).alias("n")))

    def finish(a):
        sigma2 = F.try_divide(a["ss"], a["n"])
        ll = -0.5 * (a["n"] * (LN_2PI + F.ln(sigma2) + 1) + a["lr"])
        return F.struct(F.when(~F.isnan(ll), ll).alias("ll"), sigma2.alias("sigma2"))

    return F.aggregate(y, init, step, finish)


def arma_exact_fit(series: DataFrame, group: str = "asset_tag", steps: int = 60) -> DataFrame:
    """``(group, phi, theta, sigma2, loglik, aic, bic, n)`` by a compass search on
    the exact likelihood: an outer fold tries a step to each side of both
    parameters, takes the best, and halves the step when none is better."""
    def at(phi, theta):
        return F.struct(phi.cast("double").alias("phi"), theta.cast("double").alias("theta"))

    def seen(p):
        return let(arma_exact(F.col("y"), p["phi"], p["theta"]), lambda v: F.struct(
            F.coalesce(v["ll"], F.lit(float("-inf"))).alias("ll"), p["phi"].alias("phi"),
            p["theta"].alias("theta"), v["sigma2"].alias("sigma2")))

    starts = F.array(*[at(F.lit(a), F.lit(b)) for a in (-0.7, 0.0, 0.7) for b in (-0.7, 0.0, 0.7)])
    begin = F.struct(F.array_max(F.transform(starts, seen)).alias("best"), F.lit(0.2).alias("step"))

    def move(acc, _):
        b, d = acc["best"], acc["step"]
        near = F.array(at(b["phi"] - d, b["theta"]), at(b["phi"] + d, b["theta"]),
                       at(b["phi"], b["theta"] - d), at(b["phi"], b["theta"] + d))
        inside = F.filter(near, lambda p: (F.abs(p["phi"]) < 0.9999) & (F.abs(p["theta"]) < 0.9999))
        return let(F.array_max(F.transform(inside, seen)), lambda m: F.when(
            m["ll"] > b["ll"], F.struct(m.alias("best"), d.alias("step")))
            .otherwise(F.struct(b.alias("best"), (d / 2).alias("step"))))

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, move)["best"]
    k, ok = 4, F.col("f.ll") > float("-inf")   # constant, both parameters, variance
    done = series.where(F.size("y") > 0).select(group, "n", fit.alias("f"))
    ll = F.when(ok, F.col("f.ll"))
    return done.select(group, *[F.when(ok, F.col(f"f.{c}")).alias(c) for c in ("phi", "theta", "sigma2")],
                       ll.alias("loglik"), (2 * k - 2 * ll).alias("aic"), (k * F.ln("n") - 2 * ll).alias("bic"), "n")
