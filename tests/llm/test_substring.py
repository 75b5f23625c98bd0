import hashlib
import random

from sentibar.llm import substring as S

from .helpers import frame, prose


def plain(rows, k=13):
    """(id, text) rows -> (n_words, n_removed, digest) each."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for x in range(len(w) - k + 1):
            g = b" ".join(w[x:x + k])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for x in range(len(w) - k + 1):
            if i is not None and first[b" ".join(w[x:x + k])] < i:
                gone.update(range(x, x + k))
        kept = b" ".join(y for x, y in enumerate(w) if x not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def rows():
    rng = random.Random(11)
    base, shared = prose(rng, 600), prose(rng, 60)
    t = [None, "", "\n \t", prose(rng, 12), base, base, base + " tail", shared, "x " + shared + "\n\ny  z",
         prose(rng, 40) + "\n" + shared + "  " + prose(rng, 40), "ka " * 500, "ka " * 30, "ka \n" * 13,
         prose(rng, 30000), "é ü " * 40]
    for n in (200, 300):
        cut = prose(rng, n).split()
        for _ in range(3):
            a = rng.randrange(n - 50)
            t.append(" \n".join(cut[a:a + 50]))
    return t


def test_windows_against_brute_force(spark):
    t = rows()
    ids = list(range(len(t)))
    random.Random(1).shuffle(ids)
    got = [tuple(r) for r in S.op7_frame(frame(spark, t, extra=True, ids=ids)).collect()]
    assert sorted(got) == sorted(plain(list(zip(ids, t))))


def test_null_and_equal_ids(spark):
    base = prose(random.Random(4), 80)
    ids, t = [5, 5, None, 9, None], [base] * 5
    got = [tuple(r) for r in S.op7_frame(frame(spark, t, ids=ids)).collect()]
    assert sorted(got, key=str) == sorted(plain(list(zip(ids, t))), key=str)


def test_rows_keep_their_columns_and_other_bytes(spark):
    shared = prose(random.Random(6), 30)
    df = frame(spark, [shared, "A  b\n" + shared + "\n\nc\td "], extra=True)
    out = S.drop_repeats(df)
    assert out.schema == df.schema
    assert {r.doc_id: r.text for r in out.collect()} == {0: shared, 1: "A  b\nc\td "}


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "MIN_WIDTH", 16)
    monkeypatch.setattr(S, "MAX_WIDTH", 16)
    monkeypatch.setattr(S, "FLUSH", 500)
    t = rows()
    got = [tuple(r) for r in S.op7_frame(frame(spark, t).repartition(5)).collect()]
    assert sorted(got) == sorted(plain(list(enumerate(t))))


def test_empty_table(spark):
    assert S.op7_frame(frame(spark, ["a"]).limit(0)).count() == 0


def test_no_task_holds_a_bucket_of_documents(spark):
    shared = prose(random.Random(7), 40)
    ids = [None] * 200 + [3] * 200 + list(range(4, 104))
    t = [shared] * 200 + [shared] * 200 + [shared + " " + prose(random.Random(i), 40) for i in range(100)]
    out = S.drop_repeats(frame(spark, t, ids=ids).repartition(4), counts=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" not in plan and "MapInArrow" in plan
    got = [(r.doc_id, r.n_words, r.n_removed) for r in out.collect()]
    assert sorted(got, key=str) == sorted([x[:3] for x in plain(list(zip(ids, t)))], key=str)


def test_buckets_follow_the_text(spark):
    df = spark.range(1)
    assert S.buckets_for(df, 0) < 50 and S.buckets_for(df, 1 << 40) >= (1 << 40) // S.DOC_BUCKET
