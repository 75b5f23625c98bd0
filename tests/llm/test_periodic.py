import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from sentibar.llm import periodic as P

from .helpers import frame, prose


def plain_runs(ws, min_length):
    """Every maximal stretch per period, smallest period first."""
    n, seen, out = len(ws), set(), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if ws[i] != ws[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and ws[j] == ws[j + p]:
                j += 1
            if j - i >= p and (i, j + p) not in seen:
                seen.add((i, j + p))
                if j + p - i >= max(min_length, 2 * p):
                    out.append((i, j + p - i, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def got_runs(ws, min_length):
    return [tuple(r) for r in P.find_runs(np.array(ws, dtype=np.int64), min_length).tolist()]


@pytest.mark.parametrize("letters,upto", [(2, 15), (3, 9)])
def test_all_short_sequences(letters, upto):
    for n in range(upto + 1):
        every = list(itertools.product(range(letters), repeat=n))
        # many documents at once, told apart by their symbols
        joined = np.array([s * letters + x for s, ws in enumerate(every) for x in ws], dtype=np.int64)
        rows = P.find_runs(joined, 2).tolist()
        by_doc = {}
        for a, length, p in rows:
            by_doc.setdefault(a // max(n, 1), []).append((a % n, length, p))
        for s, ws in enumerate(every):
            assert by_doc.get(s, []) == plain_runs(ws, 2), ws


def test_random_periodic_sequences():
    rng = random.Random(4)
    for _ in range(1500):
        ws = []
        while len(ws) < 120:
            if rng.random() < 0.6:
                root = [rng.randint(0, 2) for _ in range(rng.randint(1, 24))]
                if rng.random() < 0.5:
                    root = (root * 4)[:rng.randint(1, 30)] + [rng.randint(0, 2)]
                ws += (root * 5)[:rng.randint(1, 4 * len(root))]
            else:
                ws += [rng.randint(0, 9) for _ in range(rng.randint(1, 5))]
        assert got_runs(ws, 3) == plain_runs(ws, 3)


def test_long_cycles():
    rng = random.Random(5)
    for root in (1, 2, 3, 64, 65, 1000):
        ws = [rng.randint(0, 10 ** 6) for _ in range(root)] * (20000 // root)
        assert got_runs([-1, *ws, -2], 12) == [(1, len(ws), root)]


def want(doc_id, text):
    """The contract, word by word."""
    ws = (text or "").encode().split()
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = plain_runs(ws, 12)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in drop)).hexdigest())


def digest(df):
    return sorted((tuple(r) for r in P.run_digests(P.periodic_runs(P.with_cycles(df))).collect()), key=repr)


def test_registered_query(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    got = sorted((tuple(r) for r in P.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == sorted((want(r["doc_id"], r["text"]) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > len(rows) // 20


def test_frame_cases(spark):
    rng = random.Random(6)
    odd = [None, "", " \t\n\x0b\f\r ", "a", "a " * 11, "a " * 12, "a\tb\n" * 6, "a b " * 5, "x" * 5000,
           "a\x00 " * 20, "é ü ü é " * 7, "a b c " * 4 + "a b d " * 4, "a b " * 12]
    odd += [prose(rng, 9) + " " + (prose(rng, k) + " ") * 4 for k in (1, 2, 3, 5, 8, 40)]
    odd += [prose(rng, 3000) * 2]
    ids = [zlib_ten(j) if j % 2 else j for j in range(len(odd) - 2)] + [None, 3]
    df = frame(spark, odd, extra=True, ids=ids)
    df = df.selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS ws", "4 AS top")
    assert digest(df) == sorted((want(i, t) for i, t in zip(ids, odd)), key=repr)
    assert digest(df.union(df).repartition(3)) == sorted((want(i, t) for i, t in zip(ids, odd) for _ in "12"), key=repr)
    assert digest(df.limit(0)) == []


def zlib_ten(j):
    """The j-th id whose crc32 ends in 0."""
    return list(itertools.islice((i for i in itertools.count() if zlib.crc32(str(i).encode()) % 10 == 0), j + 1))[j]


def test_real_outputs(spark):
    df = frame(spark, ["p q " + "u v w " * 5 + "end"])
    r = P.periodic_runs(df).first()
    assert [tuple(x) for x in r.runs] == [(2, 15, 3)] and r.collapsed == "p q u v w end"
