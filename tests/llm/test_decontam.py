import time
import random

import numpy as np

from sentibar.llm import decontam as D

from .helpers import frame, prose


def plain_tiling(item, doc, least):
    """Longest common unmarked run by trying all starts; repeat."""
    fi, fd, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and fi[a + n] and fd[b + n] and item[a + n] == doc[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return covered
        for x in range(n):
            fi[a + x] = fd[b + x] = False
        covered += n


def test_tiling_covers_what_greedy_search_covers():
    rng = random.Random(8)
    for _ in range(60):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 25))]
        doc = [rng.randrange(4) for _ in range(rng.randint(1, 40))]
        got = D.tiling(D.W.mix(np.array(item, np.uint64)), D.W.mix(np.array(doc, np.uint64)), 3)
        longest = max((t[2] for t in got), default=0)
        want = plain_tiling(item, doc, 3)
        assert bool(got) == bool(want)
        for a, b, n in got:
            assert item[a:a + n] == doc[b:b + n]
        assert len({x for a, _, n in got for x in range(a, a + n)}) == sum(t[2] for t in got)
        assert len({x for _, b, n in got for x in range(b, b + n)}) == sum(t[2] for t in got)
        if want:
            assert longest >= 3


def case(spark):
    rng = random.Random(2)
    items = [prose(rng, 40), prose(rng, 30), "one two three", None, "", prose(rng, 40)]
    w = items[0].split()
    moved = " ".join(w[20:40]) + ". filler words here " + " ".join(w[:20])
    docs = [prose(rng, 500), prose(rng, 100) + " " + items[0].upper() + "! " + prose(rng, 100), moved,
            " ".join(w[:15]), "say: One, two THREE.", "one two x three", None, "", items[1] + " " + items[5],
            items[1], prose(rng, 20000) + " " + items[5]]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, id string")
    return docs, bench, {(1, 0), (2, 0), (4, 2), (8, 1), (8, 5), (9, 1), (10, 5)}


def test_pairs(spark, monkeypatch):
    docs, bench, want = case(spark)
    for size in (D.GROUP_BYTES, 200):   # one group of items, and several
        monkeypatch.setattr(D, "GROUP_BYTES", size)
        got = D.contaminated_pairs(frame(spark, docs, extra=True), bench).collect()
        assert {(r.id, r.item) for r in got} == want and len(got) == len(want)
        assert all(r.coverage >= D.COVERAGE for r in got)
        clean = D.drop_contaminated(frame(spark, docs, extra=True), bench)
        assert sorted(r.doc_id for r in clean.collect()) == [0, 3, 5, 6, 7]
        assert clean.columns == frame(spark, docs, extra=True).columns


def test_registered_query_against_plain_pairs(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{d}/documents.parquet").to_pylist()
    items = pq.read_table(f"{d}/benchmark.parquet").to_pylist()

    def plain(t):
        return (t or "").lower().encode().translate(D.PLAIN).split()

    want = set()
    for r in docs:
        w = plain(r["text"])
        grams = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        for b in items:
            x = plain(b["text"])
            spots = {j for i in range(len(x) - 4) if tuple(x[i:i + 5]) in grams for j in range(i, i + 5)}
            if len(spots) >= D.COVERAGE * len(x):
                want.add((r["doc_id"], b["item_id"]))
    got = {(r.doc_id, r.item_id) for r in D.op4_decontamination(spark, d).collect()}
    assert got == want and want


def test_equal_words_do_not_multiply():
    """Twenty items of 200 equal words against documents of 20,000 of them."""
    items = D.Items(list(range(20)), ["and " * 200] * 20, 5)
    start = time.process_time()
    got = D.matched(items, ["and " * 20000, "and " * 150, "and " * 90 + "or " * 500, None], 0.6)
    assert sorted((d, i, share) for d, i, share, *_ in got) == [
        (d, i, s) for d, s in ((0, 1.0), (1, 0.75)) for i in range(20)]
    assert time.process_time() - start < 20


def test_repeated_phrases_are_tiled():
    item = "a b c d e f g h " * 10
    items = D.Items([1], [item], 5)
    doc = "x " + "a b c d e f g h " * 3 + "y " + "a b c d e f g h " * 6 + "z"
    (d, i, share, n, longest), = D.matched(items, [doc], 0.6)
    assert (share, n, longest) == (72 / 80, 2, 48)


def test_empty_tables(spark):
    docs, bench, _ = case(spark)
    assert D.contaminated_pairs(frame(spark, docs).limit(0), bench).count() == 0
    assert D.contaminated_pairs(frame(spark, docs), bench.limit(0)).count() == 0
    assert D.drop_contaminated(frame(spark, docs), bench.limit(0)).count() == len(docs)
