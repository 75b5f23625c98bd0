"""Plain versions and fixtures for the training-data operators."""

from __future__ import annotations

import random

SYLLABLES = "an be co du el fi go hu in jo ka lu".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def frame(spark, texts, extra=False, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("id", "fp", "component", "h", "pos", "kept"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def unite(pairs, nodes):
    """Smallest node reachable from each node."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
