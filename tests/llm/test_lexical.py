import math
import random
import re

import numpy as np
import pytest

from sentibar.llm import lexical as L

from .helpers import frame, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(SMALL))


def want(docs, items, k=10):
    """Every document scored for every item: (item, rank, id, score)."""
    texts = [(i, cut(t)) for i, t in docs]
    total, length = sum(bool(ws) for _, ws in texts), sum(len(ws) for _, ws in texts)
    lists = {}
    for item, text in items:
        lists.setdefault(item, set()).update(cut(text))
    df = {}
    for _, ws in texts:
        for t in set(ws):
            df[t] = df.get(t, 0) + 1
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, own in lists.items():
        scored = []
        for i, ws in texts:
            m = 10 + (90 * len(ws) * total) // max(length, 1)
            s = sum(weight[t] * ((10 ** 9 * ws.count(t)) // (1000 * ws.count(t) + 8 * m)) for t in own & set(ws))
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(docs, items, **kw):
    return sorted((tuple(r) for r in L.ranked_search(docs, items, **kw).collect()), key=repr)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_search_in_one_shard(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(L, "FIRST_DEPTH", 2)
    for _ in range(300):
        n, m = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        impact = rng.integers(0, 6, (n, m)) * rng.integers(0, 2, (n, m))
        doc, term = np.nonzero(impact)
        lists = L.Shard(doc, term, impact[doc, term], n)
        for k in (1, 3, 10):
            wanted = np.sort(rng.choice(m + 2, int(rng.integers(0, m + 2)), replace=False))
            score = impact[:, wanted[wanted < m]].sum(axis=1)
            found, value = lists.search(wanted, k)
            assert (score[found] == value).all()
            rank = sorted((-s, i) for i, s in enumerate(score) if s > 0)[:k]
            assert sorted((-s, i) for i, s in zip(found.tolist(), value.tolist()))[:k] == rank


@pytest.mark.parametrize("shard,vocabulary", [(50, 1 << 24), (1 << 20, 300)])
def test_frame_cases(spark, monkeypatch, shard, vocabulary):
    monkeypatch.setattr(L, "FIRST_DEPTH", 3)
    rng = random.Random(8)
    texts = [None, "", " \t- --", "AB ab Ab", "É é ÀB àb", "x_y x-y x`y 0a{b", "a\x7fb a\x80b", "日本 語"]
    texts += [prose(rng, rng.randint(1, 30)) for _ in range(80)]
    texts += [texts[20]] * 30 + [prose(rng, 20000)] + ["an be co"] * 5
    ids = list(range(len(texts) - 3)) + [None, None, 5]
    items = [(0, "an be co du"), (1, "AB é àb x y 0a"), (2, None), (3, ""), (4, "nothing-here"), (4, "an"), (None, "fi"),
             (5, prose(rng, 200)), (5, prose(rng, 200)), (6, texts[20]), (7, "日本 語 b")]
    docs = frame(spark, texts, extra=True, ids=ids).selectExpr("*", "1 AS n", "2 AS term", "3 AS item", "4 AS rank")
    items_df = benchmark(spark, items).selectExpr("*", "1 AS item", "2 AS term")
    assert got(docs.repartition(3), items_df, shard=shard, vocabulary_bytes=vocabulary) == want(zip(ids, texts), items)
    one = got(docs, items_df, k=1, shard=shard)
    assert one == want(list(zip(ids, texts)), items, k=1)


def test_empty_tables(spark):
    docs, items = frame(spark, ["an be", "co"]), benchmark(spark, [(1, "an")])
    assert got(docs.limit(0), items) == [] and got(docs, items.limit(0)) == []
    assert got(docs.where("doc_id = 0"), items) == want([(0, "an be")], [(1, "an")])


def test_registered_query(spark):
    import pyarrow.parquet as pq

    top = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{top}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{top}/benchmark.parquet").to_pylist()]
    found = L.op12_lexical_search(spark, top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want(docs, items)
