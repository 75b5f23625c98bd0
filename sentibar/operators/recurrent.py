"""A recurrent sequence model with a fixed reservoir (echo state).

A look-back sequence is folded into one state vector,
``s <- (1 - leak) s + leak tanh(u0 + U x + W s)``, with fixed random ``U`` and ``W``
(``W`` scaled to a spectral radius below one, so early inputs fade).  Only the
read-out is fitted: a ridge regression on the last state and the last inputs.
The fold is a column expression; the read-out's normal equations are one
grouped sum for all series and are solved in a column expression
(:mod:`trend`), so nothing is fitted on the driver or series by series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from .ml import model_frame
from .stats import lookback_sequences, standardize, unstandardize
from .trend import gram, solve_positive

UNITS, LEAK, RADIUS, INPUT_SCALE, SEED = 16, 0.5, 0.8, 0.5, 42


def reservoir(inputs: int, units: int = UNITS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    u = rng.uniform(-INPUT_SCALE, INPUT_SCALE, (units, 1 + inputs))   # the first: a constant
    w = rng.uniform(-1, 1, (units, units))
    return u, w * (RADIUS / np.abs(np.linalg.eigvals(w)).max())


def literal(rows: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def echo_state(seq: Column, inputs: int, units: int = UNITS, seed: int = SEED) -> Column:
    """The state after an array of input vectors (oldest first)."""
    u, w = reservoir(inputs, units, seed)
    both = literal(np.hstack([u, w]))

    def step(state, x):
        seen = F.concat(F.array(F.lit(1.0)), x, state)
        drive = F.transform(both, lambda row: F.tanh(F.aggregate(
            F.zip_with(row, seen, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))
        return F.zip_with(state, drive, lambda s, d: s * (1 - LEAK) + d * LEAK)

    return F.aggregate(seq, F.array(*[F.lit(0.0)] * units), step)


def recurrent_regression(features: DataFrame, cols, target: str = "realized_vol_22d", seq_len: int = FV.SEQ_LEN,
                         min_rows: int = FV.MIN_SEQ_ROWS, fit_on: str | None = "split", reg: float = 0.01,
                         group: str = "asset_tag", name: str = "recurrent", units: int = UNITS) -> DataFrame:
    """Hold-out rows with ``<name>_pred``: z-scored features and target, one state
    per look-back sequence, ridge read-out on the train rows."""
    cols = list(cols)
    frame = model_frame(features, cols, target, group)
    z = standardize(frame, [*cols, target], group=group, fit_on=fit_on)
    seq = lookback_sequences(z, [f"{c}_z" for c in cols], f"{target}_z", seq_len, min_rows, group,
                             keep=["split", target, f"_m_{target}", f"_s_{target}"])
    vectors = F.transform("seq", lambda s: F.array(*[s[f"{c}_z"] for c in cols]))
    rows = seq.withColumn("_v", vectors).withColumn("x", F.concat(
        F.array(F.lit(1.0)), echo_state(F.col("_v"), len(cols), units), F.try_element_at("_v", F.lit(-1))))
    p = 1 + units + len(cols)
    train = rows.where("split = 'train'").select(group, "x", F.col("y").alias("y"))
    both = F.array(F.struct("i", "j", "s"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    entry = gram(train, group).select(group, F.explode(both).alias("e")).select(group, "e.*").distinct()
    line = entry.groupBy(group, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))),
                                                     lambda e: e["s"]).alias("row"))
    square = line.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))),
                                                 lambda r: r["row"]).alias("m"))
    n = F.get(F.get("m", F.lit(0)), F.lit(0))
    system = F.transform(F.slice("m", 1, p), lambda r, i: F.transform(
        r, lambda v, j: F.when((i == j) & (i > 0), v + F.lit(reg) * n).otherwise(v)))
    fit = square.select(group, solve_positive(system, p).alias("b"))
    score = F.aggregate(F.zip_with("b", "x", lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
    back = unstandardize(score, F.col(f"_m_{target}"), F.col(f"_s_{target}"))
    return (rows.where("split = 'test'").join(fit, group)
            .select(group, "trading_session", target, back.alias(f"{name}_pred")))
