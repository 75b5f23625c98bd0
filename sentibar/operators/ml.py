"""Model jobs on the feature table (H9-H15, H19) with ``pyspark.ml``.

Training data never leaves the cluster: each fit is a distributed
``pyspark.ml`` job over the series' train rows, prediction is
``model.transform`` over the hold-out rows, and the driver only sees
metrics and fitted models.  Series are fitted independently (the published
pipeline fits one model per asset); the per-series fits are launched from a
small thread pool so several Spark jobs run concurrently.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.numeric import ensure_columns, sanitize
from ..sources.io import replace_table, scratch_path
from .stats import chrono_split, error_metrics, lookback_sequences, standardize, unstandardize

TASK_ROWS = 50_000          # rows of a series that one task of a fit holds

FEATURE_SETS = {"Baseline": FV.FEATURES_BASELINE, "FinBERT": FV.FEATURES_FINBERT,
                "Gemma": FV.FEATURES_GEMMA}


def boosted(seed: int = 42, max_iter: int = 100, step: float = 0.1, depth: int = 6):
    """H9 defaults: 100 trees, learning rate 0.1, depth 6, seed 42."""
    return GBTRegressor(maxIter=max_iter, stepSize=step, maxDepth=depth, seed=seed,
                        featuresCol="features", labelCol="label")


def forest(seed: int = 42, trees: int = 100, depth: int = 15):
    """H10 defaults: 100 trees on all features per split, bootstrap rows."""
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed,
                                 featureSubsetStrategy="all", featuresCol="features",
                                 labelCol="label")


def model_frame(features: DataFrame, cols, target: str = "realized_vol_22d",
                group: str = "asset_tag") -> DataFrame:
    """B15/B16/B18 + E11: sanitized rows with every feature and the target,
    a chronological train/test split per series."""
    df = ensure_columns(features, cols)
    df = sanitize(df, list(cols) + [target]).dropna(subset=[target] + list(cols))
    return chrono_split(df, group=group)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Materialise a training input once in the shared folder.

    Iterative learners scan their input once per iteration; a written table
    serves them and every later fit, needs no release and survives lost
    executors."""
    return replace_table(df, scratch_path(df.sparkSession, name))


def _assets(df: DataFrame, group: str) -> list:
    # Distinct series keys only (a handful of values), not data rows.
    return [r[0] for r in df.select(group).distinct().orderBy(group).collect()]


def series_rows(df: DataFrame, group: str) -> dict:
    """Rows of each series (a handful of keys), in order of the keys."""
    return {r[0]: r["count"] for r in df.groupBy(group).count().orderBy(group).collect()}


def fit_predict(frame: DataFrame, cols, estimator_factory, pred_col: str,
                target: str = "realized_vol_22d", group: str = "asset_tag",
                keys=("trading_session",), threads: int = 4):
    """Fit one model per series on train rows, predict its test rows.
    Returns (predictions DataFrame, {asset: model})."""
    asm = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")
    data = stored(asm.transform(frame).select(group, *keys, "split", "features", F.col(target).alias("label")),
                  "training")
    rows = series_rows(data, group)

    def one(a):
        sub = data.filter(F.col(group) == a)
        # A tree fit is thousands of short stages: each task answers the driver in every one of them.
        tasks = max(1, math.ceil(rows[a] / TASK_ROWS))
        model = estimator_factory().fit(sub.filter(F.col("split") == "train").coalesce(tasks))
        pred = (model.transform(sub.filter(F.col("split") == "test"))
                .select(group, *keys, F.col("prediction").alias(pred_col)))
        return a, model, pred

    with ThreadPoolExecutor(max_workers=threads) as ex:
        results = list(ex.map(one, rows))
    preds = None
    for _, _, p in results:
        preds = p if preds is None else preds.unionByName(p)
    return preds, {a: m for a, m, _ in results}


def feature_set_compare(features: DataFrame, sets=None, models=("XGBoost", "RandomForest"),
                        target: str = "realized_vol_22d", group: str = "asset_tag"):
    """Every feature set x model x series -> (metrics, predictions).

    All sets share the rows of the widest set (the pipeline drops rows with
    a missing value in any feature of the richest set)."""
    sets = sets or FEATURE_SETS
    widest = sorted({c for s in sets.values() for c in s})
    frame = stored(model_frame(features, widest, target, group), "model-frame")
    factories = {"XGBoost": ("xgb", boosted), "RandomForest": ("rf", forest)}
    test = frame.filter(F.col("split") == "test").select(group, "trading_session", "close",
                                                         "log_return_1d", target)
    combos = [(var, cols, mname) for var, cols in sets.items() for mname in models]

    def run(combo):
        var, cols, mname = combo
        prefix, fac = factories[mname]
        pc = f"{prefix}_pred_{var.lower()}"
        preds, _ = fit_predict(frame, cols, fac, pc, target, group)
        m = error_metrics(preds.join(test, [group, "trading_session"]), target, pc, [group])
        return preds, m.select(group, F.lit(var).alias("variation"), F.lit(mname).alias("model"),
                               "rmse", "mae")

    # Independent fits: submit them together so their many short jobs overlap.
    with ThreadPoolExecutor(max_workers=len(combos)) as ex:
        results = list(ex.map(run, combos))
    metrics, wide = [], test
    for preds, m in results:
        wide = wide.join(preds, [group, "trading_session"], "left")
        metrics.append(m)
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m)
    return out, wide


def shapley_attribution(frame: DataFrame, model, cols, group_value,
                        group: str = "asset_tag") -> DataFrame:
    """Exact Shapley values of a fitted model on the test rows of one
    series, relative to the train-mean baseline, with the feature's value
    (which is what a dependence plot shows).

    Every subset of the features is one evaluation point: features inside take
    the row's value, the others the baseline.  A feature's value is a weighted
    sum of the 2**p predictions, so all of them come out of one pre-aggregated
    ``groupBy`` per row; meant for the published sets of about ten features.
    """
    p = len(cols)
    if p > 12:
        raise ValueError("exact attribution evaluates 2**p subsets; p is at most 12")
    sub = frame.filter(F.col(group) == group_value)
    base = sub.filter(F.col("split") == "train").agg(*[F.avg(c).alias(f"_b_{c}") for c in cols])
    test = sub.filter(F.col("split") == "test").select(group, "trading_session", *cols)
    # Baseline values as scalar subqueries: stay lazy, nothing is collected.
    b = [base.select(f"_b_{c}").scalar() for c in cols]
    pts = test.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit((1 << p) - 1))))
    inside = [F.col("_m").bitwiseAND(F.lit(1 << i)) > 0 for i in range(p)]
    pts = pts.withColumns({f"_v{i}": F.when(inside[i], F.col(c)).otherwise(b[i]) for i, c in enumerate(cols)})
    asm = VectorAssembler(inputCols=[f"_v{i}" for i in range(p)], outputCol="features",
                          handleInvalid="keep")
    pred = model.transform(asm.transform(pts))
    # weight of a subset of s others: s! (p - s - 1)! / p!
    weight = [math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p) for s in range(p)]
    size = F.bit_count("_m")
    w_in = F.element_at(F.array(*[F.lit(w) for w in weight]), F.greatest(size, F.lit(1)))
    w_out = F.element_at(F.array(*[F.lit(w) for w in weight]), F.least(size + 1, F.lit(p)))
    aggs = [F.sum(F.when(inside[i], F.col("prediction") * w_in).otherwise(-F.col("prediction") * w_out))
            .alias(f"_s{i}") for i in range(p)]
    wide = pred.groupBy(group, "trading_session", *cols).agg(*aggs)
    long = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                              F.col(f"_s{i}").alias("shap")) for i, c in enumerate(cols)])
    return wide.select(group, "trading_session", F.explode(long).alias("_f")).select(
        group, "trading_session", "_f.*")


def attribution_summary(shap: DataFrame, group: str = "asset_tag") -> DataFrame:
    """Global importance: mean |phi| per feature."""
    return shap.groupBy(group, "feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def lookback_regression(features: DataFrame, cols, target: str = "realized_vol_22d",
                        seq_len: int = FV.SEQ_LEN, min_rows: int = FV.MIN_SEQ_ROWS,
                        fit_on: str | None = "split", reg: float = 0.01,
                        group: str = "asset_tag", name: str = "lookback"):
    """Z-scored features and target, 30-row look-back sequences
    flattened into one vector, ridge regression per series on train
    targets, predictions inverse-transformed on test targets."""
    frame = model_frame(features, cols, target, group)
    z = standardize(frame, list(cols) + [target], group=group, fit_on=fit_on)
    # Train/test is decided by the target row's split.
    seq = lookback_sequences(z, [f"{c}_z" for c in cols], f"{target}_z", seq_len, min_rows, group,
                             keep=["split", target, f"_m_{target}", f"_s_{target}"])
    flat = F.flatten(F.transform("seq", lambda s: F.array(*[s[f"{c}_z"] for c in cols])))
    data = seq.select(group, "trading_session", "split", target, f"_m_{target}", f"_s_{target}",
                      F.col("y").alias("label"), flat.alias("_flat"))
    from pyspark.ml.functions import array_to_vector
    data = stored(data.withColumn("features", array_to_vector(F.col("_flat"))).drop("_flat"), "sequences")
    assets = _assets(data, group)

    def one(a):
        sub = data.filter(F.col(group) == a)
        m = LinearRegression(regParam=reg, elasticNetParam=0.0, featuresCol="features",
                             labelCol="label").fit(sub.filter(F.col("split") == "train"))
        return m.transform(sub.filter(F.col("split") == "test"))

    with ThreadPoolExecutor(max_workers=4) as ex:
        parts = list(ex.map(one, assets))
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    back = unstandardize(F.col("prediction"), F.col(f"_m_{target}"), F.col(f"_s_{target}"))
    return pred.select(group, "trading_session", target, back.alias(f"{name}_pred"))


def season_fit(df: DataFrame, y: str = "close", day: str = "trading_session",
               group: str = "asset_tag", period: float = 365.25) -> DataFrame:
    """y = b0 + b1 t + b2 sin(2 pi t / P) + b3 cos(2 pi t / P) per series.

    Regressors and target are centred on the series means first (so no sum
    cancels), the centred cross products are one grouped aggregate, and the
    3x3 normal equations are solved by Cramer's rule in column expressions."""
    t = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")
    ang = F.lit(2 * math.pi / period) * t
    x = df.filter(F.col(y).isNotNull()).select(
        group, t.alias("t"), F.sin(ang).alias("s"), F.cos(ang).alias("c"), F.col(y).cast("double").alias("y"))
    means = x.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("_t0"),
                                 *[F.avg(v).alias(f"_m{v}") for v in "tscy"])
    z = x.join(means, group).select(group, *[(F.col(v) - F.col(f"_m{v}")).alias(v) for v in "tscy"])
    pairs = [a + b for i, a in enumerate("tscy") for b in "tscy"[i:]]
    gram = z.groupBy(group).agg(*[F.sum(F.col(p[0]) * F.col(p[1])).alias(p) for p in pairs]).join(means, group)

    def g(a, b):
        return F.col("".join(sorted((a, b), key="tscy".index)))

    def det(cols):
        (a, b, c) = [[g(r, k) for r in "tsc"] for k in cols]
        return (a[0] * (b[1] * c[2] - b[2] * c[1]) - b[0] * (a[1] * c[2] - a[2] * c[1])
                + c[0] * (a[1] * b[2] - a[2] * b[1]))

    whole = det("tsc")
    out = gram.select("*", *[F.try_divide(det("tsc".replace(v, "y")), whole).alias(f"b_{v}") for v in "tsc"])
    mean = F.col("_my") - sum(F.col(f"b_{v}") * F.col(f"_m{v}") for v in "sc")
    ssr = F.col("yy") - sum(F.col(f"b_{v}") * g(v, "y") for v in "tsc")
    one = mean - F.col("b_t") * (F.col("_mt") - F.col("_t0"))
    return out.select(group, "n", one.alias("b_one"), "b_t", "b_s", "b_c",
                      F.sqrt(F.greatest(ssr, F.lit(0.0)) / F.col("n")).alias("rmse"))
