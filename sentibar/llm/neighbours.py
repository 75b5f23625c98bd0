"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 11).

Nearness is the largest inner product.  Vectors are scaled by the largest norm
and lifted onto the unit sphere by one more coordinate, queries are scaled to
length one; there the Euclidean distance falls as the inner product grows.  A
table hashes a point by ``floor((a . x + b) / width)`` for a few Gaussian (that
is, 2-stable) directions ``a``; the floors are its cell.  A query visits the
cells around its own in the order of their estimated success: a neighbour at
cosine ``s`` projects to ``s`` times the query's projection with deviation
``sqrt(1 - s * s)``, so each perturbed floor has a probability and a cell the
product of them.  The candidates of all tables are merged; what decides is the
exact double-precision inner product of the original vectors.

The tables are fitted: up to ``SAMPLE`` queries are answered exactly, in
blocks, and the cheapest setting (directions, tables, probes) whose probes
reach ``RECALL`` of these answers is taken, cost being rows compared plus probes
sent.  Where neighbours hardly differ from other points (random vectors of many
dimensions) that setting visits most cells; where they are close, few.

Skew: of identical vectors only the ``k + 1`` smallest ids can be among any
``k`` nearest, so the rest are not indexed (they are still queries).  A cell
with many rows or many visits is cut into parts on both sides; every part of
the one meets every part of the other, block by block, so no cell is capped.
Each table's most promising cell is visited first; its k-th score is the floor
below which the later cells send nothing.
A query that found fewer than ``k`` candidates is compared with every row.

Defined cases: rows without an id or a vector, and vectors that are zero, hold
a null or a non-finite component, or have another length than the most common
one (of equally common ones the longest) take no part; of rows that share an
id the smallest vector counts; with fewer than ``k`` other vectors all are
returned; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import broadcast_if_bounded
from .common import pick, read, saved

SAMPLE = 128           # queries that are answered exactly to fit the tables
POINTS = 2048          # rows on which a setting's visits are estimated
RECALL = 0.95          # of the sample's neighbours that the probes must reach
MOST_PROBES = 512
PROBE_ROWS = 200       # what sending one probe costs, in rows compared
CELL_ROWS, CELL_VISITS = 4096, 4096
REACH = 2              # floors on either side of the query's own
FOUND = "query long, id long, score double"


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)``: the vectors that take part, one for each id."""
    src = pick(vectors, id=id_col, vec=vec_col)
    if src.schema["vec"].dataType.simpleString() != "array<float>":
        src = src.withColumn("vec", F.col("vec").cast("array<double>"))
    inf = F.lit(float("inf"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))
    rows = (src.withColumn("id", F.col("id").cast("long"))
            .where(F.col("id").isNotNull() & whole & F.exists("vec", lambda x: x != 0))
            .groupBy("id").agg(F.min("vec").alias("vec")))
    return saved(rows, "near-vectors")


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column, in double precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def nearest_rows(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of ``c`` for each row of ``q``: query index,
    candidate index, exact score.  Products of whole blocks choose, with a
    margin for their rounding; the scores are sums over one pair at a time."""
    by_id = np.argsort(c_id, kind="stable")
    sorted_id = c_id[by_id]
    norm = np.sqrt((c * c).sum(axis=1)).max(initial=0.0)
    step, out = max(1, (1 << 21) // max(len(c), 1)), []
    for lo in range(0, len(q), step):
        own, own_id = q[lo:lo + step], q_id[lo:lo + step]
        score = own @ c.T
        at = np.minimum(np.searchsorted(sorted_id, own_id), len(c) - 1)
        self_row = np.flatnonzero(sorted_id[at] == own_id)
        score[self_row, by_id[at[self_row]]] = -np.inf
        floor = np.full(len(own), -np.inf)
        if len(c) > k:
            margin = 1e-13 * own.shape[1] * norm * np.sqrt((own * own).sum(axis=1))
            floor = np.partition(score, len(c) - k, axis=1)[:, len(c) - k] - margin
        i, j = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        exact = np.empty(len(i))
        for a in range(0, len(i), 1 << 14):
            exact[a:a + (1 << 14)] = (own[i[a:a + (1 << 14)]] * c[j[a:a + (1 << 14)]]).sum(axis=1)
        order = np.lexsort((c_id[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[rank < k] + lo, j[rank < k], exact[rank < k]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query.  A candidate of several tables has one
    score and so one dense rank; the group limit runs below the exchange."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
            .dropDuplicates(["query", "id"]))


@dataclass(frozen=True)
class Tables:
    """One fitted setting: ``directions`` (tables x floors x dimensions + 1)."""

    directions: np.ndarray
    shift: np.ndarray
    width: float
    cosine: float
    scale: float
    probes: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))[:, None]])

    @staticmethod
    def level(q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, keepdims=True, initial=1e-300)
        q = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
        return np.hstack([q, np.zeros((len(q), 1))])

    def cells(self, lifted: np.ndarray, table: int) -> np.ndarray:
        return mixed(np.floor((lifted @ self.directions[table].T + self.shift[table]) / self.width).astype(np.int64))

    def visits(self, level: np.ndarray, table: int, most: int | None = None) -> np.ndarray:
        """The cells each query visits, most promising first.

        A cell's estimate is a product with one factor for each direction, so
        the best cells over the first directions hold the beginnings of the
        best ones over all: each step extends only those."""
        most = most or self.probes
        project = level @ self.directions[table].T
        floors = np.floor((project + self.shift[table]) / self.width).astype(np.int64)
        offsets = np.arange(-REACH, REACH + 1)
        spread = math.sqrt(max(1 - self.cosine ** 2, 1e-12))
        n = len(level)
        chance, cell = np.ones((n, 1)), np.zeros((n, 1), dtype=np.int64)
        for j in range(project.shape[1]):
            low = (floors[:, j, None] + offsets) * self.width - self.shift[table, j]
            mean = self.cosine * project[:, j, None]
            p = normal_below((low + self.width - mean) / spread) - normal_below((low - mean) / spread)
            wide = (chance[:, :, None] * np.maximum(p, 1e-30)[:, None, :]).reshape(n, -1)
            order = np.argsort(-wide, axis=1, kind="stable")[:, :most]
            chance = np.take_along_axis(wide, order, 1)
            parent, step = order // len(offsets), order % len(offsets)
            cell = mixed_step(np.take_along_axis(cell, parent, 1),
                              np.take_along_axis(floors[:, j, None] + offsets, step, 1))
        return cell


def mixed_step(code: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """One more floor in a cell's 64-bit number.  Cells that share a number
    only share their candidates."""
    with np.errstate(over="ignore"):
        return (code ^ (code >> 29)) * np.int64(-0x61C8864680B583EB) + floor + np.int64(0x1B873593)


def mixed(floors: np.ndarray) -> np.ndarray:
    code = np.zeros(len(floors), dtype=np.int64)
    for j in range(floors.shape[1]):
        code = mixed_step(code, floors[:, j])
    return code


def normal_below(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (logistic form, error below 2e-4)."""
    x = np.clip(x, -9, 9)
    return 1 / (1 + np.exp(-(1.5976 * x + 0.07056 * x ** 3)))


def exact_sample(candidates: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """``(query, id, score)``: the sample's ``k`` nearest of all rows, in blocks."""
    shared = candidates.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_id, own = shared.value
        for batch in batches:
            c_id = batch.column("id").to_numpy()
            i, j, score = nearest_rows(own, q_id, matrix(batch.column("vec")), c_id, k)
            yield pa.record_batch([pa.array(q_id[i]), pa.array(c_id[j]), pa.array(score)],
                                  names=["query", "id", "score"])

    return best(candidates.mapInArrow(run, FOUND), k)


def fit(candidates: DataFrame, queries: DataFrame, k: int, recall: float, seed: int) -> Tables | None:
    """The cheapest setting that reaches ``recall`` of the sample's neighbours;
    None (compare all) where none does so for less than a full scan costs."""
    total, scale = candidates.agg(F.count("*"), F.max(norm("vec"))).first()
    few = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not few.num_rows or total <= k + 1:
        return None
    q_id, q = few.column("id").to_numpy(), matrix(few.column("vec"))
    truth = exact_sample(candidates, q_id, q, k).select("query", "id", "score").toArrow()
    near = candidates.join(F.broadcast(candidates.sparkSession.createDataFrame(
        [(int(i),) for i in np.unique(truth.column("id").to_numpy())], "id long")), "id").toArrow()
    some = candidates.orderBy(F.xxhash64("id"), "id").limit(POINTS).toArrow()
    by_id = np.argsort(q_id)
    who = by_id[np.searchsorted(q_id[by_id], truth.column("query").to_numpy())]
    near_id = near.column("id").to_numpy()
    order = np.argsort(near_id)
    which = order[np.searchsorted(near_id[order], truth.column("id").to_numpy())]
    level = Tables.level(q)
    blank = Tables(np.zeros(0), np.zeros(0), 1.0, 0.0, scale, 1)
    points, near = blank.lift(matrix(some.column("vec"))), blank.lift(matrix(near.column("vec")))
    cosine = float(np.quantile((level[who] * near[which]).sum(axis=1), 0.05))
    cosine = min(max(cosine, 0.0), 1 - 1e-9)
    width = 2 * math.sqrt(2 - 2 * cosine)
    cheapest, choice = float(total), None
    rng = np.random.default_rng(seed)
    for floors in (1, 2, 3, 4, 6, 8, 10, 12, 16):
        hit = np.full(len(who), MOST_PROBES)
        seen = np.full((0, len(q), len(points)), MOST_PROBES)
        made = Tables(rng.normal(size=(4, floors, level.shape[1])), rng.uniform(0, width, (4, floors)),
                      width, cosine, scale, MOST_PROBES)
        for t in range(4):
            visits = made.visits(level, t)
            hit = np.minimum(hit, place(visits, who, made.cells(near, t)[which]))
            pairs = np.repeat(np.arange(len(q)), len(points))
            seen = np.append(seen, place(visits, pairs, np.tile(made.cells(points, t), len(q)))
                             .reshape(1, len(q), -1), axis=0)
            probes = int(np.sort(hit)[min(math.ceil(recall * len(hit)), len(hit)) - 1]) + 1
            cost = (seen < probes).mean(axis=(1, 2)).sum() * total + PROBE_ROWS * probes * (t + 1)
            if t and probes <= MOST_PROBES and (choice is None or cost < cheapest):
                cheapest = cost
                choice = Tables(made.directions[:t + 1], made.shift[:t + 1], width, cosine, scale, probes)
    return choice


def place(visits: np.ndarray, who: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """At which visit query ``who[i]`` reaches ``cell[i]`` (MOST_PROBES: never)."""
    out = np.full(len(who), MOST_PROBES)
    border = np.searchsorted(who, np.arange(len(visits) + 1)) if (np.diff(who) >= 0).all() else None
    for i in range(len(visits)):
        mine = slice(border[i], border[i + 1]) if border is not None else np.flatnonzero(who == i)
        order = np.argsort(visits[i], kind="stable")
        at = np.minimum(np.searchsorted(visits[i][order], cell[mine]), len(order) - 1)
        out[mine] = np.where(visits[i][order][at] == cell[mine], order[at], MOST_PROBES)
    return out


def norm(name: str) -> Column:
    return F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def hashed(rows: DataFrame, name: str, tables: Tables | None, turns: slice | None = None) -> DataFrame:
    """``(tab, cell, <name>, vec, floor)``: each row in every table, at its own cell
    or at the cells that it visits in these ``turns``.  ``floor`` is what a score
    must reach (null: anything counts)."""
    kind = rows.schema["vec"].dataType.simpleString()
    if "floor" not in rows.columns:
        rows = rows.withColumn("floor", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = matrix(part.column("vec"))
                x = tables.lift(x) if turns is None else tables.level(x)
                for t in range(len(tables.directions)):
                    cell = tables.cells(x, t)[:, None] if turns is None else tables.visits(x, t)[:, turns]
                    at = pa.array(np.repeat(np.arange(len(x)), cell.shape[1]))
                    yield pa.record_batch(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(cell.ravel()),
                         *[part.column(c).take(at) for c in ("id", "vec", "floor")]],
                        names=["tab", "cell", name, "vec", "floor"])

    if tables is None:  # one cell for all
        return rows.select(F.lit(0).alias("tab"), F.lit(0).cast("long").alias("cell"), F.col("id").alias(name), "vec",
                           "floor")
    return saved(rows.select("id", "vec", "floor")
                 .mapInArrow(run, f"tab int, cell long, {name} long, vec {kind}, floor double"), f"near-{name}s")


def compare(index: DataFrame, visits: DataFrame, k: int, cell_rows: int, cell_visits: int) -> DataFrame:
    """``(query, id, score)``: the ``k`` nearest of each visit's cell part."""
    rows = index.groupBy("tab", "cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))
    asks = visits.groupBy("tab", "cell").agg(F.ceil(F.count("*") / cell_visits).cast("int").alias("ask_parts"))
    sizes = saved(rows.join(asks, ["tab", "cell"]), "near-sizes")
    sizes = broadcast_if_bounded(sizes, 16 << 20, sizes.count())

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(key), F.col(own + "s")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1)).alias(other)
        return df.join(sizes, ["tab", "cell"]).select("tab", "cell", part, every, key, "vec", "floor")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c_id, q_id = left.column("id").to_numpy(), right.column("query").to_numpy()
        if not len(c_id) or not len(q_id):
            i = j = np.zeros(0, np.int64)
            score = np.zeros(0)
        else:
            i, j, score = nearest_rows(matrix(right.column("vec")), q_id, matrix(left.column("vec")), c_id, k)
            floor = right.column("floor").fill_null(-np.inf).to_numpy()
            i, j, score = (x[score >= floor[i]] for x in (i, j, score))
        return pa.table([q_id[i], c_id[j], score], names=["query", "id", "score"])

    keys = ["tab", "cell", "part", "ask_part"]
    return (dealt(index, "id", "part", "ask_part").groupBy(*keys)
            .cogroup(dealt(visits, "query", "ask_part", "part").groupBy(*keys)).applyInArrow(run, FOUND))


def nearest(vectors: DataFrame, queried: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            recall: float = RECALL, seed: int = 11, cell_rows: int = CELL_ROWS,
            cell_visits: int = CELL_VISITS) -> DataFrame:
    """``(query, rank, id, score)``: for each row that ``queried`` (over ``id``)
    names, its ``k`` nearest other rows."""
    rows = clean(vectors, id_col, vec_col)
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query long, rank int, id long, score double")
    rows = rows.where(F.size("vec") == size["n"])
    copies = Window.partitionBy("vec").orderBy("id")
    candidates = saved(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
                       .select("id", "vec"), "near-candidates")
    queries = rows.where(queried)
    tables = fit(candidates, queries, k, recall, seed)
    index = hashed(candidates, "id", tables)
    found = saved(best(compare(index, hashed(queries, "query", tables, slice(0, 1)), k, cell_rows, cell_visits), k),
                  "near-first")
    if tables is not None and tables.probes > 1:
        # the first cells' k-th score is a floor: the other cells send little beyond it
        floors = found.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("floor"))
        rest = hashed(queries.join(floors, "id", "left"), "query", tables, slice(1, None))
        more = compare(index, rest, k, cell_rows, cell_visits)
        found = saved(best(found.select("query", "id", "score").unionByName(more), k), "near-found")
    if tables is not None:
        least = min(k, size["count"] - 1)
        enough = found.groupBy("query").agg(F.max("rank").alias("n")).where(F.col("n") >= least)
        short = saved(queries.join(enough, F.col("id") == F.col("query"), "left_anti"), "near-short")
        if not short.isEmpty():
            whole = best(compare(hashed(candidates, "id", None), hashed(short, "query", None), k, cell_rows,
                                 cell_visits), k)
            found = found.join(enough, "query", "left_semi").unionByName(whole)
    return found.select("query", F.col("rank").cast(T.IntegerType()).alias("rank"), "id", "score")


def op11_nearest(spark, sf_dir):
    found = nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
