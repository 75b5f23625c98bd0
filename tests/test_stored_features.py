"""The model fits read one stored feature table."""

import datetime as dt

from sentibar.plans import q_ml as Q
from sentibar.sources.tables import Tables


def write_tables(spark, top):
    day = dt.datetime(1995, 1, 2)
    lines = [(i, 1, 1, 1, 5.0 + i % 7, 100.0 + (i * 37) % 11, "ANR"[i % 3], "O", day + dt.timedelta(days=i // 3)) for i in range(180)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
                          ).write.parquet(f"{top}/lineitem.parquet")
    orders = [(i, i, "FOP"[i % 3], 1.0, day + dt.timedelta(days=i // 3), "2-HIGH") for i in range(180)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{top}/orders.parquet")
    return Tables(spark, str(top))


def test_features_are_built_once(spark, tmp_path, monkeypatch):
    t, calls, plain = write_tables(spark, tmp_path), [], Q.features

    def counted(tables):
        calls.append(1)
        return plain(tables)

    want = sorted(map(tuple, plain(t).collect()))
    monkeypatch.setattr(Q, "features", counted)
    assert Q.with_residual(t).count() == Q.with_residual(t).count() == len(want) > 50
    assert sorted(map(tuple, Q.stored_features(t).collect())) == want
    assert len(calls) == 1
