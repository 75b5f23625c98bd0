import hashlib
import random
from collections import Counter

import numpy as np

from sentibar.llm import suffixes as S

from .helpers import frame, prose


def plain(texts, span):
    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for r in raw:
        for i in range(len(r) - span + 1):
            seen[r[i:i + span]] += 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i:i + span]] > 1:
                gone[i:i + span] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(21)
    base, shared = prose(rng, 500), prose(rng, 120)
    t = [None, "", "a" * 399, base, base, base[:1500] + "X" + base[1501:], shared, "q" + shared, shared + "z"]
    t += [prose(rng, 50) + shared + prose(rng, 50) for _ in range(6)]
    t += ["a" * 1000, "b" * 402, "b" * 401, "ab" * 300, "ba" * 205, "abc" * 150 + base[:600], "Thhaen " * 90]
    t += [base[200:640], "é" + base[200:640] + "é", base[300:699], base[300:700], prose(rng, 4000)]
    t.append(t[-1][500:900] + t[-1][500:901] + shared[100:])
    t += ["".join(rng.choice("ab") for _ in range(3000)), "\0" * 700, "\0" * 450 + "x"]
    return t


def check(spark, t, ids=None, **options):
    ids = list(range(len(t))) if ids is None else ids
    got = S.op1_frame(frame(spark, t, extra=True, ids=ids).repartition(3), **options).collect()
    want = plain(t, options.get("span", S.SPAN))
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == sorted((i or -1, *w) for i, w in zip(ids, want))


def test_against_brute_force(spark):
    check(spark, texts())


def test_small_chunks_and_hot_names(spark):
    check(spark, texts(), chunk=2)
    check(spark, texts(), chunk=2, hot=3)
    check(spark, texts(), chunk=2, hot=0)


def test_short_spans(spark):
    rng = random.Random(2)
    t = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["a" * 30]
    check(spark, t, span=12, gap=5)
    check(spark, t, span=12, gap=4, chunk=5, hot=6)


def test_null_and_equal_ids(spark):
    base = prose(random.Random(3), 200)
    check(spark, [base, base, base + "x", "y" * 500], ids=[4, 4, None, None])


def test_registered_query(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[1:] for r in S.op1_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    want = plain([r["text"] for r in rows], 400)
    assert got == {r["doc_id"]: w for r, w in zip(rows, want)}
    assert any(w[1] for w in want)


def test_empty_table(spark):
    assert S.op1_frame(frame(spark, ["a"]).limit(0)).count() == 0


def test_a_name_not_foreseen_as_hot_is_still_split(spark, monkeypatch):
    monkeypatch.setattr(S, "hot_names", lambda *a: np.zeros(0, np.uint64))
    check(spark, texts(), chunk=1, hot=0)


def test_equal_rows_list_each_range_once(spark, monkeypatch):
    base = prose(random.Random(9), 200)
    cut = S.merged

    def counted(places):
        if len(places) > 1 and len({(r["lo"], r["hi"]) for r in places.to_pylist()}) < len(places):
            raise AssertionError("a range is listed twice")
        return cut(places)

    monkeypatch.setattr(S, "merged", counted)
    check(spark, [base] * 20, ids=[7] * 20)
    check(spark, [base] * 20, ids=[None] * 20)
