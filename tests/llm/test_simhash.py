import random

import numpy as np
import xxhash

from sentibar.llm import simhash as S

from .helpers import frame, prose, unite


def plain_fp(text, k=3):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
    if not grams and words:
        grams = [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, bits=3):
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= bits]
    label = unite(pairs, set(fps))
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    return [least.get(label[f]) for f in fps]


def texts():
    rng = random.Random(5)
    out = []
    for n in (0, 1, 2, 3, 40, 400, 3000):
        base = prose(rng, n)
        out += [base, base, base.upper()]
        for _ in range(4):
            w = base.split()
            for _ in range(1 + n // 200):
                if w:
                    w[rng.randrange(len(w))] = "ka"
            out.append("  ".join(w))
    return out + [None, "", " \n\t", "é a b c d", "the " * 700]


def test_components_match_all_pairs(spark):
    t = texts()
    got = {r.doc_id: r for r in S.op2_frame(frame(spark, t, extra=True)).collect()}
    fps = [plain_fp(x) for x in t]
    assert [got[i].fingerprint for i in range(len(t))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(t))] == plain_components(range(len(t)), fps)


def test_registered_query(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in S.op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    fps = [plain_fp(r["text"]) for r in rows]
    want = plain_components([r["doc_id"] for r in rows], fps)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want)}


def test_hot_groups_are_cut_again_without_loss(spark):
    rng = random.Random(9)
    fps = set()
    for seg in (0x12345678, 0xDEADBEEF00000000):
        for _ in range(120):
            x = seg
            for _ in range(rng.randint(0, 8)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = plain_components(signed, list(fps))
    for hot in (2, 5, 4096):
        linked = {r.node: r.component for r in S.components(S.near_edges(df, 3, hot)).collect()}
        label = {f: linked.get(f, f) for f in signed}
        groups, expected = {}, {}
        for f, w in zip(signed, want):
            groups.setdefault(label[f], set()).add(f)
            expected.setdefault(w, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())), hot


def test_keep_one_and_odd_rows(spark):
    rng = random.Random(1)
    a, b = prose(rng, 300), prose(rng, 300)
    df = frame(spark, [a, a, b, b, a, None, ""], extra=True, ids=[7, 3, None, None, 3, 9, 8])
    kept = S.simhash_keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect()) == \
        sorted([(3, a), (-1, b), (8, "")])


def test_rows_of_one_id_in_different_groups(spark):
    """Equal ids with unrelated texts: no text is lost, and the result is one."""
    rng = random.Random(2)
    a, b, c = (prose(rng, 200) for _ in range(3))
    texts, ids = [a, b, c, a, b, b], [5, 5, 7, 9, None, 5]
    for order in (slice(None), slice(None, None, -1)):
        df = frame(spark, texts[order], ids=ids[order]).repartition(3)
        kept = sorted((r.doc_id, r.text) for r in S.simhash_keep_one(df).collect())
        assert kept == sorted([(5, a), (5, b), (7, c)])
    long = frame(spark, [prose(rng, 20000)] * 2 + ["x"] * 3, ids=[1, 2, 3, 3, 3])
    assert sorted(r.doc_id for r in S.simhash_keep_one(long).collect()) == [1, 3]


def test_empty_table(spark):
    df = frame(spark, ["a"]).limit(0)
    assert S.op2_frame(df).count() == 0
    assert S.simhash_keep_one(df).count() == 0
