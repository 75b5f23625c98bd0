"""Tables by month: an update touches the files of its months only."""

import datetime as dt

from pyspark.sql import functions as F

from sentibar.sources import months as MO


def table(spark, n=120):
    rows = [(i, dt.date(2024, 1 + i % 4, 1 + i % 28) if i % 30 else None, float(i), None) for i in range(n)]
    return spark.createDataFrame(rows, "k long, day date, v double, s double")


def files(spark, path):
    return {r.f.rsplit("/", 2)[1]: set() for r in []} or {
        (r.m, r.f.rsplit("/", 1)[1]) for r in MO.read_months(spark, path)
        .select(F.col(MO.MONTH).cast("string").alias("m"), F.col("_metadata.file_path").alias("f")).distinct().collect()}


def rows(spark, path):
    return sorted((r.k, r.day, r.v, r.s) for r in MO.read_months(spark, path).collect())


def test_update_rewrites_only_its_months(spark, tmp_path):
    path = str(tmp_path / "t")
    MO.write_months(table(spark), path, "day", "k", rows_per_file=10)
    before, old = files(spark, path), rows(spark, path)
    assert {m for m, _ in before} == {"2024-01", "2024-02", "2024-03", "2024-04", "none"}
    assert len([f for m, f in before if m == "2024-02"]) > 1          # a month is written by several tasks
    up = spark.createDataFrame([(1, 5.0), (1, 4.0), (5, 6.0), (999, 1.0)], "k long, s double")   # both in February
    assert MO.update_months(spark, path, up, "k", ["s"]) == ["2024-02"]
    after = files(spark, path)
    assert {f for f in before if f[0] != "2024-02"} == {f for f in after if f[0] != "2024-02"}
    assert not {f for f in before if f[0] == "2024-02"} & after
    want = [(k, d, v, {1: 4.0, 5: 6.0}.get(k, s)) for k, d, v, s in old]
    assert rows(spark, path) == want
    # a replay changes nothing
    assert MO.update_months(spark, path, up, "k", ["s"]) == ["2024-02"] and rows(spark, path) == want
    assert MO.update_months(spark, path, up.where("k = 999"), "k", ["s"]) == []
    assert MO.update_months(spark, path, spark.createDataFrame([(0, 7.0)], "k long, s double"), "k", ["s"]) == ["none"]


def test_append_skips_what_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    first = table(spark).where("k < 60")
    assert len(MO.append_months(spark, path, first, "day", "k", ["v"])) == 5
    before = files(spark, path)
    assert MO.append_months(spark, path, first.withColumn("v", F.lit(-1.0)), "day", "k", ["v"]) == []
    assert files(spark, path) == before
    more = spark.createDataFrame([(500, dt.date(2024, 3, 9), 1.0, None), (500, dt.date(2024, 3, 9), 2.0, None),
                                  (501, dt.date(2025, 7, 1), 3.0, None)], first.schema)
    assert MO.append_months(spark, path, more.union(first), "day", "k", ["v"]) == ["2024-03", "2025-07"]
    got = rows(spark, path)
    assert len(got) == 62 and [r for r in got if r[0] >= 500] == [
        (500, dt.date(2024, 3, 9), 1.0, None), (501, dt.date(2025, 7, 1), 3.0, None)]
    assert {f for f in before if f[0] not in ("2024-03", "2025-07")} <= files(spark, path)
