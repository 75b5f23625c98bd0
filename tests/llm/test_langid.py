import math
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sentibar.llm import langid as L

from .helpers import frame


def plain_bits(counts, text):
    """PPM, method C, order 2, frozen counts, byte by byte."""
    data, bits = b"\n\n" + text.encode(), 0.0
    for i in range(2, len(data)):
        p = 1.0
        for order in (2, 1, 0):
            followers = counts[data[i - order:i]]
            if not followers:
                continue
            total, kinds = sum(followers.values()), len(followers)
            if data[i] in followers:
                p *= followers[data[i]] / (total + kinds)
                break
            p *= kinds / (total + kinds)
        else:
            p /= 256
        bits -= math.log2(p)
    return bits


def plain_model(texts):
    counts = defaultdict(lambda: defaultdict(int))
    for t in texts:
        data = b"\n\n" + t.encode()
        for i in range(2, len(data)):
            for order in (2, 1, 0):
                counts[data[i - order:i]][data[i]] += 1
    return counts


def test_code_lengths_are_those_of_the_context_trees(spark):
    train = {"x": ["abab abba baab", "é ab", "ab\n"], "y": ["cdcd dcdc", "", "cab"]}
    df = spark.createDataFrame([(k, t) for k, v in train.items() for t in v], "lang string, text string")
    trained = L.train(df)
    model = trained.model(trained.langs)
    texts = ["abba", "", "cdc", "zé\U0001f600", "a", "ab", "b" * 300]
    import pyarrow as pa

    data, at = L.W.text_buffer(pa.array(texts))
    got = model.code_lengths(data, at)
    for j, lang in enumerate(model.langs):
        counts = plain_model(train[lang])
        for i, t in enumerate(texts):
            assert abs(got[i, j] - plain_bits(counts, t)) < 1e-3 * (1 + got[i, j])


def test_held_out_accuracy_and_folds(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in pq.read_table(f"{d}/documents.parquet").to_pylist()}
    got = L.op8_language_id(spark, d).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and rows[r.doc_id]["lang"] and r.lang_pred != "und"]
    assert sum(r.lang_pred == rows[r.doc_id]["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    texts = ["hello there world", None, "", "123 !?", "日本", "hola que tal", "x" * 200000, "hello there world"]
    df = frame(spark, texts, extra=True, ids=[1, 2, 3, 4, 5, 6, None, 1])
    df = df.withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 6, "es"))
    got = sorted(((r.id or 0, r.lang_pred) for r in L.predict(df, L.train(df)).collect()))
    assert [p for i, p in got if i in (2, 3, 4)] == ["und"] * 3
    assert [p for i, p in got if i == 1] == ["en", "en"] and (6, "es") in got
    none = L.predict(df, L.train(df.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert L.predict(df.limit(0), L.train(df)).count() == 0


def test_groups_of_languages_give_the_same(spark):
    rows = [("en", "hello there world"), ("es", "hola que tal mundo"), ("de", "guten tag welt"), ("it", "ciao bella gente"),
            ("xx", "hello there world")]
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows * 2)], "doc_id long, lang string, text string")
    odd = df.union(df.selectExpr("doc_id", "lang", "'123' AS text")).union(df.selectExpr("doc_id", "lang", "NULL AS text"))

    def result(trained):
        return sorted((r.id, r.lang_pred, round(r.score, 9)) for r in L.predict(odd, trained).collect())
    whole, parts = L.train(df), L.train(df, model_bytes=1)
    assert len(whole.groups()) == 1 and len(parts.groups()) == 5
    got = result(whole)
    assert got == result(parts)
    assert {p for i, p, _ in got if i in (0, 4)} == {"en", "und"}         # equal codes: the first name


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", L.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
