"""Source/sink round trips through the shared scratch folder."""

import math

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from sentibar.operators import pages as PG
from sentibar.sources import fixtures as FX
from sentibar.sources.tables import Tables


def test_csv_roundtrip_keeps_every_bar(spark):
    back = E.queries()["csv_roundtrip"](spark, SF_SMALL)
    bars = FX.bars_from_lineitem(Tables(spark, SF_SMALL).lineitem)
    assert back.count() == bars.count()
    assert back.select("time", "symbol").distinct().count() == back.count()


def test_json_merge_first_title_wins(spark):
    merged = E.queries()["json_merge_roundtrip"](spark, SF_SMALL)
    titles = PG.page_fields(Tables(spark, SF_SMALL).pages).filter(F.col("title") != "")
    assert merged.count() == titles.select("title").distinct().count()
    assert merged.select("headline").distinct().count() == merged.count()
    assert set(merged.columns) == {"headline", "summary", "content", "raw_time", "tags", "category",
                                   "author", "provider", "url"}


def test_file_stats_count_empty_and_broken_files(spark):
    s = E.queries()["merge_file_stats"](spark, SF_SMALL).collect()[0]
    n_pages = Tables(spark, SF_SMALL).pages.count()
    assert s.files_scanned == math.ceil(n_pages / 50) + 2     # data files + empty + broken
    assert s.empty_files == 1 and s.invalid_files == 1
    assert s.unique_records + s.duplicates == n_pages


def test_table_versions_add_the_residual_column(spark):
    from sentibar.sources.io import describe
    d = {r.column_name: r.column_type for r in describe(E.queries()["table_versions"](spark, SF_SMALL)).collect()}
    assert d["garch_residual"] == "double" and len(d) == 29


def test_optional_table_falls_back_and_sink_reads_back(spark):
    fb = E.queries()["optional_table_fallback"](spark, SF_SMALL)
    assert "Hybrid" in {r.model for r in fb.select("model").distinct().collect()}
    sink = E.queries()["metrics_sink"](spark, SF_SMALL)
    assert sink.count() == fb.filter(F.col("model") != "Hybrid").count()


def test_valid_large_and_repeated_key_files_keep_their_rows(spark, tmp_path):
    from sentibar.sources import io as IO
    body = "x" * 2000
    rows = ",".join('{"title": "t%d", "id": "%d", "body": "%s"}' % (i, i, body) for i in range(12000))
    (tmp_path / "big.json").write_text("[" + rows + "]")                       # 24 MB
    (tmp_path / "keys.json").write_text('[{"title": "first", "title": "last", "id": "n/a"}, {"title": "z", "id": 7}]')
    (tmp_path / "broken.json").write_text('[{"title": "lost"}, {"title": ')
    (tmp_path / "empty.json").write_text("[]")
    got = IO.read_json_articles(spark, str(tmp_path))
    assert got.count() == 12002
    small = got.filter(~F.col("title").startswith("t")).select("title", "id").collect()
    assert sorted((r.title, r.id) for r in small) == [("last", None), ("z", 7)]
    stats = {r._file.rsplit("/", 1)[1]: (r.invalid, r.empty) for r in IO.file_stats(spark, str(tmp_path)).collect()}
    assert stats == {"big.json": (False, False), "keys.json": (False, False), "broken.json": (True, False),
                     "empty.json": (False, True)}


def test_first_row_of_the_first_file_wins_not_the_smallest(spark, tmp_path):
    from sentibar.operators import keys as K
    from sentibar.sources import io as IO
    head = "datetime,symbol,open,high,low,close,volume\n"
    (tmp_path / "a.csv").write_text(head + "2024-01-02 00:00:00,X,9,9,9,9,1\n2024-01-02 00:00:00,X,2,2,2,2,1\n")
    (tmp_path / "b.csv").write_text(head + "2024-01-02 00:00:00,X,1,1,1,1,1\n")
    back = IO.read_bars_csv_ordered(spark, str(tmp_path))
    assert [r.open for r in K.insert_ignore(None, back, ["time", "symbol"], IO.FILE_ORDER).collect()] == [9.0]
