import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sentibar.llm import interp as I

from .helpers import frame, prose


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def plain(rows, learns):
    """Base scores, and the model with EM over exact deleted shares."""
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if learns(i):
            w = tokens(t)
            uni.update(w)
            bi.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)

    def bucket(c):
        return int(math.log2(c + 1))

    held = Counter()
    for (h, w), c in bi.items():
        c1 = uni[h] - 1
        held[bucket(c1), (c - 1) / max(c1, 1), (uni[w] - 1) / max(1, n - 1)] += c
    weight = {}
    for b in {k[0] for k in held}:
        rows_b = [(p2, p1, c) for (x, p2, p1), c in held.items() if x == b]
        p = np.array([(p2, p1, 1 / (v + 1)) for p2, p1, _ in rows_b])
        c = np.array([x[2] for x in rows_b], float)
        l = np.full(3, 1 / 3)
        for _ in range(200):
            q = l * p
            q *= (c / q.sum(1))[:, None]
            l = q.sum(0) / q.sum()
        weight[b] = l
    out = {}
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((uni[x] + .5) / (n + .5 * (v + 1))) for x in w)
        score = 0.0
        for h, x in zip([None, *w], w):
            l = weight.get(bucket(uni[h]))
            if l is not None:
                l = np.maximum(l, 1e-6)
                p = l * np.array([bi[h, x] / max(uni[h], 1) * (uni[h] > 0), uni[x] / max(n, 1), 1 / (v + 1)])
                score += math.log10(max(p.sum(), 1e-300))
        out[i] = (len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out


def test_registered_query_against_plain_counts_and_em(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet").to_pylist()]
    want = plain(rows, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    got = {r.doc_id: r for r in I.op10_interpolated_lm(spark, d).collect()}
    assert len(got) == len(rows)
    for i, (n_tokens, known, n, base, score) in want.items():
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n_tokens, known, n)
        assert g.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(g.base_score - base) < 1e-6 * abs(base)
        if n_tokens > 20:
            assert abs(g.score - score) < 0.03 * abs(score) + 1   # the EM histogram has steps of 1/8 octave
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_batches_and_shards_do_not_change_scores(spark, monkeypatch):
    rng = random.Random(1)
    t = [prose(rng, rng.randint(0, 60)) for _ in range(60)] + [None, "", "The THE the", "z" * 5000]
    df = frame(spark, t, extra=True).repartition(3)
    one = {r.doc_id: tuple(r)[1:] for r in I.op10_frame(df).collect()}
    monkeypatch.setattr(I, "BATCH_BYTES", 500)
    many = {r.doc_id: tuple(r)[1:] for r in I.op10_frame(df.repartition(7)).collect()}
    assert one.keys() == many.keys()
    for i in one:
        assert one[i][:4] == many[i][:4] and np.allclose(one[i][4:], many[i][4:], rtol=1e-9)


def test_weights_maximise_the_likelihood():
    cells = np.array([(3 << 32) | (9 << 16) | 33, (3 << 32) | (0 << 16) | 17, (2 << 32) | (0 << 16) | 0])
    n = np.array([70.0, 30.0, 5.0])
    w = I.learn_weights(cells, n, 1000)
    p = np.array([[2 ** -1.0, 2 ** -4.0, 1 / 1001], [0, 2 ** -2.0, 1 / 1001]])

    def likelihood(l):
        return (n[:2] * np.log(p @ l)).sum()

    for step in np.random.default_rng(0).dirichlet(np.ones(3), 200):
        assert likelihood(w[3]) >= likelihood(0.9 * w[3] + 0.1 * step) - 1e-4
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and (w[4] == w[3]).all()


def test_odd_rows(spark):
    df = frame(spark, ["a b", None, "a b", ""], ids=[None, 2, 2, None])
    got = I.score_documents(df, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 3] and {r.train_tokens for r in got} == {8}
    none = I.score_documents(df, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and all(abs(r.score) < 1e-9 for r in none)
    assert I.op10_frame(df.limit(0)).count() == 0
