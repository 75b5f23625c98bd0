"""Exact Shapley values of tree ensembles for any number of features.

A tree's output for a mix of two points (the row where a feature is "in", the
baseline where it is "out") depends only on which leaf the mix reaches.  A leaf
is a box: for each feature on its path an interval.  Against one leaf a feature
is one of four kinds: both points lie in its interval (it does not matter),
only the row does, only the baseline does, or neither does (the leaf is never
reached).  With ``a`` features of the second kind and ``c`` of the third, the
leaf is reached exactly by the mixes that have all of the former in and all of
the latter out, so its value ``v`` gives each former
``v * (a - 1)! c! / (a + c)!`` and takes ``v * a! (c - 1)! / (a + c)!`` from
each latter.  That is the sum over all 2**p subsets, at the cost of one pass
over the leaves of a row: nothing grows with 2**p.

Models come as their node tables (as ``pyspark.ml`` saves them), so all series
are one plan.  The leaves of bounded ensembles go to every task, which works
them off one feature at a time for a slice of rows at once; beyond that bound
rows meet the leaves of their series in a join, and the contributions are
partially aggregated per row before any shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import replace_table, scratch_path
from ..sources.tables import spread

INF = float("inf")
BOX_BYTES = 40          # a feature's interval in a leaf
#: Spark's trees are at most 30 deep, so a path holds at most 30 features.
FACTORIAL = [float(math.factorial(i)) for i in range(32)]


def ensemble_nodes(spark, model) -> DataFrame:
    """``(tree, node, left, right, feature, threshold, value)`` of a fitted
    ensemble; ``value`` carries the tree's weight."""
    path = scratch_path(spark, "ensemble")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    scale = F.lit(1.0) if "GBT" in type(model).__name__ else F.lit(1.0 / sum(model.treeWeights))
    return nodes.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
        (n["prediction"] * F.element_at(weights, F.col("treeID") + 1) * scale).alias("value"))


def leaf_boxes(nodes: DataFrame, group: str, depth: int = 30) -> DataFrame:
    """``(group, leaf, value, box)``: per leaf the interval of each feature on
    its path, ``low < x <= high``.  One join a level, until no inner node is left."""
    inner = nodes.where("left >= 0").select(group, "tree", F.col("node").alias("at"), "left", "right", "feature",
                                            "threshold")
    leaves = nodes.where("left < 0").select(group, "tree", F.col("node").alias("at"), "value")
    empty = F.array().cast("array<struct<feature:int,low:double,high:double>>")
    front = nodes.where("node = 0").select(group, "tree", F.lit(0).alias("at"), empty.alias("path"))
    done = None
    for _ in range(depth + 1):
        ended = front.join(leaves, [group, "tree", "at"])
        done = ended if done is None else done.unionByName(ended)
        here = front.join(inner, [group, "tree", "at"])
        here = replace_table(here, scratch_path(nodes.sparkSession, "tree-level"))
        if here.isEmpty():
            break

        def cond(low, high):
            return F.concat("path", F.array(F.struct(F.col("feature").cast("int").alias("feature"),
                                                     low.alias("low"), high.alias("high"))))

        left = here.select(group, "tree", F.col("left").alias("at"), cond(F.lit(-INF), F.col("threshold")).alias("path"))
        right = here.select(group, "tree", F.col("right").alias("at"), cond(F.col("threshold"), F.lit(INF)).alias("path"))
        front = left.unionByName(right)
    # several conditions on one feature are one interval
    def merged(path):
        return F.transform(F.array_distinct(F.transform(path, lambda p: p["feature"])), lambda f: F.struct(
            f.alias("feature"),
            F.array_max(F.transform(F.filter(path, lambda p: p["feature"] == f), lambda p: p["low"])).alias("low"),
            F.array_min(F.transform(F.filter(path, lambda p: p["feature"] == f), lambda p: p["high"])).alias("high")))

    return done.select(group, F.struct("tree", "at").alias("leaf"), "value", merged(F.col("path")).alias("box"))


def within(x: Column, box: Column) -> Column:
    """The split rule: values up to a threshold go left, larger ones and NaN right."""
    return ((box["low"] == -INF) | (x > box["low"])) & ((box["high"] == INF) | (x <= box["high"]))


def point(cols) -> Column:
    """Feature values as the models see them: a missing one is NaN."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])


def gathered(boxes: DataFrame, group: str) -> dict:
    """Per series the leaves' values and, per feature, the leaves that ask for it
    with interval and whether it holds the baseline."""
    out = {}
    for g, part in boxes.toPandas().groupby(group, sort=False):
        held: dict = {}
        for leaf, box in enumerate(part["box"]):
            for p in box:
                held.setdefault(p["feature"], []).append((leaf, p["low"], p["high"], p["base"]))
        sides = {f: (np.array([h[0] for h in one]), np.array([h[1] for h in one], float),
                     np.array([h[2] for h in one], float), np.array([h[3] for h in one], bool))
                 for f, one in held.items()}
        out[g] = part["value"].to_numpy(float), sides
    return out


def row_shapley(x: np.ndarray, value: np.ndarray, sides: dict, cells: int = 1 << 20) -> np.ndarray:
    """Contributions of the features (columns) to each row of ``x``."""
    out = np.zeros(x.shape)
    n = np.arange(len(FACTORIAL))
    fact = np.array(FACTORIAL)
    both = np.array(FACTORIAL + [INF] * len(FACTORIAL))[n[:, None] + n]
    gives = fact[np.maximum(n - 1, 0)][:, None] * fact / both
    takes = fact[:, None] * fact[np.maximum(n - 1, 0)] / both
    step = max(1, cells // max(1, len(value)))
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        shape = (len(part), len(value))
        a, c, dead, kinds = np.zeros(shape, np.int8), np.zeros(shape, np.int8), np.zeros(shape, bool), []
        for f, (leaf, low, high, base) in sides.items():
            v = part[:, f, None]
            inside = ((low == -INF) | (v > low) | np.isnan(v)) & ((high == INF) | (v <= high))
            row, mean = inside & ~base, ~inside & base
            a[:, leaf] += row
            c[:, leaf] += mean
            dead[:, leaf] |= ~inside & ~base
            kinds.append((f, leaf, row, mean))
        reached = np.where(dead, 0.0, value)
        up, down = reached * gives[a, c], reached * takes[a, c]
        for f, leaf, row, mean in kinds:
            out[lo:lo + step, f] = np.where(row, up[:, leaf], 0.0).sum(axis=1) - np.where(mean, down[:, leaf], 0.0).sum(axis=1)
    return out


def tree_shapley(frame: DataFrame, nodes: DataFrame, cols, group: str = "asset_tag",
                 key: str = "trading_session", max_bytes: int = 64 << 20) -> DataFrame:
    """``(group, key, feature, value, shap)`` for the test rows of every series in
    ``nodes``, relative to the mean of its train rows."""
    cols = list(cols)
    base = frame.where("split = 'train'").groupBy(group).agg(*[F.avg(c).alias(c) for c in cols])
    # which intervals hold the baseline is settled once a leaf
    boxes = (leaf_boxes(nodes, group).join(base.select(group, point(cols).alias("_b")), group)
             .select(group, "value", F.transform("box", lambda p: F.struct(
                 p["feature"].alias("feature"), p["low"].alias("low"), p["high"].alias("high"),
                 within(F.get(F.col("_b"), p["feature"]), p).alias("base"))).alias("box")))
    boxes = replace_table(boxes, scratch_path(frame.sparkSession, "leaf-boxes"))
    test = frame.where("split = 'test'").select(group, key, *cols).withColumn("_x", point(cols))
    if (boxes.agg(F.sum(F.size("box"))).first()[0] or 0) * BOX_BYTES <= max_bytes:
        leaves = frame.sparkSession.sparkContext.broadcast(gathered(boxes, group))

        @F.pandas_udf("array<double>")
        def shapley(g: pd.Series, x: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(g), dtype=object)
            for name, at in g.groupby(g, sort=False).indices.items():
                for i, one in zip(at, row_shapley(np.stack(x.iloc[at].to_list()), *leaves.value[name])):
                    out.iloc[i] = one
            return out

        known = spread(test.join(boxes.select(group).distinct(), group, "left_semi"))
        every = F.explode(F.transform(F.col("_s"), lambda s, i: F.struct(
            F.get(F.array(*[F.lit(c) for c in cols]), i).alias("feature"),
            F.get(F.array(*[F.col(c).cast("double") for c in cols]), i).alias("value"), s.alias("shap"))))
        return known.withColumn("_s", shapley(group, "_x")).select(group, key, every.alias("_f")).select(group, key, "_f.*")
    side = boxes
    kinds = F.transform("box", lambda p: F.struct(
        p["feature"].alias("feature"),
        F.when(within(F.get(F.col("_x"), p["feature"]), p), F.when(p["base"], 0).otherwise(1))
        .when(p["base"], -1).alias("kind")))
    met = test.select(group, key, "_x").join(side, group).select(group, key, "value", kinds.alias("k"))
    met = met.where(~F.exists("k", lambda p: p["kind"].isNull())).select(
        group, key, "value", F.filter("k", lambda p: p["kind"] != 0).alias("k"))
    met = met.select(group, key, "value", F.explode("k").alias("p"),
                     F.size(F.filter("k", lambda p: p["kind"] == 1)).alias("a"),
                     F.size(F.filter("k", lambda p: p["kind"] == -1)).alias("c"))
    fact = F.array(*[F.lit(x) for x in FACTORIAL])

    def f(n):
        return F.get(fact, n)

    gives = F.when(F.col("p.kind") == 1, f(F.col("a") - 1) * f(F.col("c"))) \
        .otherwise(-f(F.col("a")) * f(F.col("c") - 1)) / f(F.col("a") + F.col("c"))
    sums = met.groupBy(group, key, F.col("p.feature").alias("_i")).agg(F.sum(F.col("value") * gives).alias("shap"))
    every = F.posexplode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                   for c in cols])).alias("_i", "_f")
    rows = test.join(side.select(group).distinct(), group, "left_semi").select(group, key, every)
    return (rows.join(sums, [group, key, "_i"], "left")
            .select(group, key, "_f.*", F.coalesce("shap", F.lit(0.0)).alias("shap")))
