"""Echo states against a plain loop; the read-out against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentibar.operators import ml as ML
from sentibar.operators import recurrent as RC


def loop(seq, units):
    u, w = RC.reservoir(seq.shape[1], units)
    s = np.zeros(units)
    for x in seq:
        s = (1 - RC.LEAK) * s + RC.LEAK * np.tanh(u[:, 0] + u[:, 1:] @ x + w @ s)
    return s


def test_states_equal_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    seqs = [rng.normal(size=(n, 3)) for n in (0, 1, 5, 30)]
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(seqs)], "i long, v array<array<double>>")
    got = {r.i: r.s for r in df.select("i", RC.echo_state(F.col("v"), 3, 8).alias("s")).collect()}
    for i, s in enumerate(seqs):
        assert got[i] == pytest.approx(loop(s, 8).tolist() if len(s) else [0.0] * 8)


def test_hold_out_beside_ridge(spark):
    """A target that depends on the last inputs, not in a straight line."""
    rng = np.random.default_rng(2)
    rows = []
    for a in ("A", "B"):
        x = rng.normal(size=(420, 2))
        for i in range(420):
            y = 0.5 + 0.3 * np.tanh(2 * x[i - 1, 0]) + 0.1 * abs(x[i - 2, 1])
            rows.append((a, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x[i, 0]), float(x[i, 1]), float(y)))
    df = spark.createDataFrame(rows, "asset_tag string, trading_session date, f0 double, f1 double, realized_vol_22d double")

    def rmse(pred, col):
        return pred.agg(F.sqrt(F.avg((F.col(col) - F.col("realized_vol_22d")) ** 2))).first()[0]

    mine = RC.recurrent_regression(df, ["f0", "f1"])
    flat = ML.lookback_regression(df, ["f0", "f1"])
    a, b = rmse(mine, "recurrent_pred"), rmse(flat, "lookback_pred")
    print("hold-out rmse: recurrent", a, "ridge on flat sequences", b)
    spread = mine.agg(F.stddev_pop("realized_vol_22d")).first()[0]
    assert a < 0.7 * spread and mine.count() == flat.count() > 100
