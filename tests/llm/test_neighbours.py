import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentibar.llm import neighbours as N


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, rank int, id string")


def rows_of(x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return [(int(i), [float(a) for a in v], 0, 0, "x") for i, v in zip(ids, x)]


def plain(ids, x, queried, k):
    """Every query against every other row."""
    out = {}
    for i in queried:
        q = x[list(ids).index(i)]
        scored = sorted((-float((q * v).sum()), j) for j, v in zip(ids, x) if j != i)
        out[i] = [(r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return out


def got(df, queried, **kw):
    out = {}
    for r in N.nearest(df, queried, **kw).collect():
        out.setdefault(r.query, []).append((r.rank, r.id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def recall(found, want):
    """Share of the true scores that were found (ties count by score)."""
    hits = total = 0
    for q, rows in want.items():
        floor = rows[-1][2]
        hits += sum(s >= floor - 1e-12 for _, _, s in found.get(q, []))
        total += len(rows)
    return hits / total


def points(rng, n, d):
    """Random directions, clusters of near copies, unequal lengths."""
    x = rng.normal(size=(n, d))
    c = rng.normal(size=(5, d))
    x[: n // 2] = c[rng.integers(0, 5, n // 2)] + 0.05 * rng.normal(size=(n // 2, d))
    return (x * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_exact_scores(spark, seed):
    x = points(np.random.default_rng(seed), 1500, 24)
    df = vectors(spark, rows_of(x)).repartition(5)
    want = plain(range(1500), x.astype(float), range(0, 1500, 20), 10)
    found = got(df, F.col("id") % 20 == 0, k=10, cell_rows=100, cell_visits=20)
    assert set(found) == set(want) and all([r for r, _, _ in v] == list(range(1, 11)) for v in found.values())
    assert recall(found, want) >= 0.9
    for q, v in found.items():
        assert [(i, s) for _, i, s in v] == sorted(((i, s) for _, i, s in v), key=lambda r: (-r[1], r[0]))
        for _, i, s in v:
            assert i != q and s == (x[q].astype(float) * x[i].astype(float)).sum()


def test_registered_query_recall(spark):
    import pyarrow.parquet as pq

    top = "/root/testdata/sf0.01"
    t = pq.read_table(f"{top}/embeddings.parquet")
    ids, x = t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), dtype=float)
    found, out = {}, N.op11_nearest(spark, top)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    for r in out.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = plain(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert set(found) == set(want) and recall(found, want) >= 0.9
    assert all(len(v) == 20 for v in found.values())


def test_probe_order_is_best_first():
    """The beam gives the cells of largest estimate, as listing all cells does."""
    rng = np.random.default_rng(5)
    q = N.Tables.level(rng.normal(size=(6, 8)))
    t = N.Tables(rng.normal(size=(1, 4, 9)), rng.uniform(0, 1, (1, 4)), 1.0, 0.5, 1.0, 625)
    every, some = t.visits(q, 0), t.visits(q, 0, 40)
    assert (every[:, :40] == some).all()
    assert all(len(set(row)) == 625 for row in every.tolist())


def test_copies_ties_and_hot_cells(spark):
    """A third of all rows are one vector; more are near copies of another."""
    rng = np.random.default_rng(7)
    x = points(rng, 600, 8)
    x[:200] = x[0]
    x[200:300] = x[200] + 1e-4 * rng.normal(size=(100, 8)).astype(np.float32)
    want = plain(range(600), x.astype(float), range(0, 600, 20), 20)
    found = got(vectors(spark, rows_of(x)), F.col("id") % 20 == 0, cell_rows=30, cell_visits=3)
    assert recall(found, want) >= 0.9
    for q in range(0, 200, 20):
        if want[q][-1][2] == want[q][0][2]:  # all of its nearest are copies: exact, ties by id
            assert found[q] == want[q]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (120, []), (140, [0.0, 0.0]), (160, [1.0, None]), (180, [nan, 1.0]), (200, [inf, 1.0]),
           (220, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0]),
           (3, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [2.0, 0.0]), (20, [-1e-30, 1e30]), (40, [3.0, 4.0])]
    df = vectors(spark, [(i, v, 0, 0, "x") for i, v in odd], "double")
    ids = [0, 1, 2, 3, 20, 40]
    x = np.array([[1.0, 0], [0.5, 0.5], [0, -1], [1, 0], [-1e-30, 1e30], [3, 4]])
    for k in (1, 3, 20):
        assert got(df, F.col("id") % 20 == 0, k=k) == plain(ids, x, [0, 20, 40], k)
    assert got(df.limit(0), F.col("id") % 20 == 0) == {}
    assert got(df.where("vec_id = 0"), F.col("id") % 20 == 0) == {}
    assert got(df, F.col("id") < 0) == {}


def test_too_few_found_are_completed(spark, monkeypatch):
    """Tables whose probes miss nearly everything still give k rows."""
    x = points(np.random.default_rng(9), 300, 6)
    far = N.Tables(np.random.default_rng(1).normal(size=(2, 16, 7)), np.zeros((2, 16)), 0.01, 0.99,
                   float(np.sqrt((x.astype(float) ** 2).sum(1)).max()), 1)
    monkeypatch.setattr(N, "fit", lambda *a: far)
    want = plain(range(300), x.astype(float), range(0, 300, 20), 20)
    assert got(vectors(spark, rows_of(x)), F.col("id") % 20 == 0) == want
