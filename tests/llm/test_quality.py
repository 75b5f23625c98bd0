import random
from collections import Counter

from sentibar.llm import quality as Q

from .helpers import frame, prose


def plain(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    grams = list(zip(w, w[1:], w[2:]))
    count = Counter(grams)
    rep = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    n = len(w)
    stats = [n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)]
    base = n < 50 or 100 * len(rep) > 50 * n
    letters = sum(any(c.isascii() and c.isalpha() or not c.isascii() for c in x) for x in w)
    top = max(Counter(w).values(), default=0)
    kept = not (base or 10 * stats[2] > n or stats[1] < 2 * n or stats[1] > 12 * n or 10 * letters < 8 * n
                or 2 * stats[3] > len(lines) or 4 * top > n)
    return (*stats, base, kept)


def texts():
    rng = random.Random(4)
    good = prose(rng, 200)
    lines = "\n".join(prose(rng, 8) for _ in range(30))
    return [None, "", " \n\t ", good, good, good.replace(" ", " | "), prose(rng, 49), prose(rng, 50), lines,
            lines + "\n" + lines, "the " * 100, good + " ###" * 30, " ".join("a" for _ in range(60)) + good,
            "x" * 2000 + " " + good, prose(rng, 20000), " ".join(str(i) for i in range(300)), "é ü ñ " * 40,
            "\r\n".join(["same line here"] * 40), good.upper(), "word " + "\x0b\x0c" + good,
            "\n".join(["q " + prose(rng, 3)] * 3) + "\n" + good]


def test_statistics_and_verdicts(spark):
    t = texts()
    got = {r.doc_id: tuple(r)[1:8] for r in Q.quality_report(frame(spark, t, extra=True)).collect()}
    assert got == {i: plain(x) for i, x in enumerate(t)}
    kept = Q.quality_filter(frame(spark, t, extra=True))
    assert kept.schema == frame(spark, t, extra=True).schema
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, x in enumerate(t) if plain(x)[-1]]


def test_order_changes_cost_not_verdicts():
    import pyarrow as pa

    data, at = Q.W.text_buffer(pa.array(texts()))
    rules = list(Q.BASE_RULES + Q.MORE_RULES)
    want = Q.verdict(Q.View(data, at), tuple(rules))
    for seed in range(10):
        random.Random(seed).shuffle(rules)
        assert (Q.verdict(Q.View(data, at), tuple(rules)) == want).all()


def test_order_follows_rejections_per_second(spark):
    df = frame(spark, ["| " * 100] * 20)
    slow = Q.Rule("slow", lambda v: [sum(range(200_000))] * 0 or Q.np.zeros(v.n, bool))
    hit = Q.Rule("hit", lambda v: v.n_symbols > 0)
    assert [r.name for r in Q.order_rules(df, "text", (slow, hit))] == ["hit", "slow"]


def test_null_ids_repeats_and_empty_table(spark):
    good = prose(random.Random(1), 80)
    df = frame(spark, [good, good, "", good], ids=[None, 3, 3, None])
    assert sorted((r.doc_id or 0, r.kept) for r in Q.quality_report(df).collect()) == [
        (0, True), (0, True), (3, False), (3, True)]
    assert Q.quality_filter(df).count() == 3
    assert Q.quality_report(df.limit(0)).count() == 0 and Q.quality_filter(df.limit(0)).count() == 0
