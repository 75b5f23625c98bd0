"""Hand-made edge frames (FIXTURES section 4)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sentibar.operators import backtest as BT
from sentibar.operators import calendar as CA
from sentibar.operators import features as FE
from sentibar.operators import keys as K
from sentibar.operators import sentiment as SE
from sentibar.operators import stats as ST
from sentibar.functions import text as TX
from sentibar.sources import fixtures as FX

D = dt.date
T = dt.datetime
NEWS_SCHEMA = ("asset_tag string, trading_session date, gemma_sentiment_score double, "
               "gemma_confidence_score double, gemma_impact_type string, finbert_sentiment double")


def _daily(spark, rows):
    return {r["trading_session"]: r for r in
            SE.daily_sentiment(spark.createDataFrame(rows, NEWS_SCHEMA)).collect()}


def test_single_article_day(spark):
    r = _daily(spark, [("X", D(2024, 1, 2), 0.4, 0.5, "Direct", 0.1)])[D(2024, 1, 2)]
    assert r.gemma_dispersion == 0.0
    assert r.gemma_conf_weighted == pytest.approx(0.4)
    assert r.news_volume == 1
    assert r.article_impact_index == pytest.approx(0.4 * math.log(2))
    assert r.direct_mean_score == pytest.approx(0.4) and r.indirect_mean_score == 0.0


def test_all_null_scores_count_rows(spark):
    r = _daily(spark, [("X", D(2024, 1, 2), None, 0.5, None, None),
                       ("X", D(2024, 1, 2), None, 0.7, None, None)])[D(2024, 1, 2)]
    assert r.news_volume == 2
    assert r.gemma_mean == 0.0 and r.gemma_conf_weighted == 0.0 and r.gemma_dispersion == 0.0


def test_zero_confidence_sum(spark):
    r = _daily(spark, [("X", D(2024, 1, 2), 0.3, 0.0, "None", 0.0)])[D(2024, 1, 2)]
    assert r.gemma_conf_weighted == 0.0


def test_confidence_denominator_includes_unscored(spark):
    r = _daily(spark, [("X", D(2024, 1, 2), 0.6, 0.5, "Direct", 0.0),
                       ("X", D(2024, 1, 2), None, 0.5, "Direct", 0.0)])[D(2024, 1, 2)]
    assert r.gemma_conf_weighted == pytest.approx(0.3)


@pytest.fixture(scope="module")
def cal(spark):
    # Weekdays minus 1 Jan / 4 Jul / 25 Dec, close 16:00 New York in UTC.
    return FX.session_calendar(spark, ranges=(("2023-12-01", "2024-04-30"),))


def _align(spark, cal, times):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, time timestamp_ntz")
    out = CA.align_to_sessions(df, cal).orderBy("id").collect()
    return [r.trading_session for r in out]


def test_close_boundary(spark, cal):
    # 2024-01-02 close = 21:00 UTC (EST).
    got = _align(spark, cal, [T(2024, 1, 2, 21, 0, 0), T(2024, 1, 2, 21, 0, 1)])
    assert got == [D(2024, 1, 2), D(2024, 1, 3)]


def test_weekend_holiday_and_friday_after_close(spark, cal):
    got = _align(spark, cal, [T(2024, 1, 5, 22, 0), T(2024, 1, 6, 12, 0),
                              T(2023, 12, 25, 10, 0), T(2023, 12, 31, 23, 0)])
    assert got == [D(2024, 1, 8), D(2024, 1, 8), D(2023, 12, 26), D(2024, 1, 2)]


def test_dst_close_moves(spark, cal):
    # After 2024-03-10 the 16:00 New York close is 20:00 UTC.
    got = _align(spark, cal, [T(2024, 3, 11, 20, 30), T(2024, 3, 8, 20, 30)])
    assert got == [D(2024, 3, 12), D(2024, 3, 8)]


def test_no_session_within_window_is_unassigned(spark):
    short = FX.session_calendar(spark, ranges=(("2024-01-01", "2024-01-05"),))
    assert _align(spark, short, [T(2024, 1, 20, 10, 0)]) == [None]


def test_egypt_weekmask_and_shift(spark):
    df = spark.createDataFrame([(T(2024, 1, 5, 9, 0),), (T(2024, 1, 6, 9, 0),),
                                (T(2024, 1, 4, 15, 0, 0, 250000),)], "time timestamp_ntz")
    rolled = [r.trading_session for r in CA.weekmask_roll(df).collect()]
    assert rolled == [D(2024, 1, 7), D(2024, 1, 7), D(2024, 1, 4)]
    shifted = [r.shifted_time for r in CA.after_close_shift_eg(df).collect()]
    # Thursday 15:00 -> Sunday 10:00, sub-second kept; morning rows unchanged.
    assert shifted[2] == T(2024, 1, 7, 10, 0, 0, 250000)
    assert shifted[0] == T(2024, 1, 5, 9, 0)


def test_us_after_close_shift(spark, cal):
    df = spark.createDataFrame([(T(2024, 1, 5, 16, 0),), (T(2024, 1, 6, 15, 0),)],
                               "time timestamp_ntz")
    got = [r.shifted_time for r in CA.after_close_shift_us(df, cal).collect()]
    assert got == [T(2024, 1, 8, 9, 30), T(2024, 1, 6, 15, 0)]


def _bars(spark, closes, vols=None, asset="X", start=D(2024, 1, 1)):
    vols = vols or [100.0] * len(closes)
    rows = [(asset, start + dt.timedelta(days=i), float(c), float(v)) for i, (c, v) in
            enumerate(zip(closes, vols))]
    df = spark.createDataFrame(rows, "asset_tag string, trading_session date, close double, volume double")
    return df.select(F.col("trading_session").cast("timestamp_ntz").alias("time"),
                     F.col("asset_tag").alias("symbol"), F.col("close").alias("open"),
                     F.col("close").alias("high"), F.col("close").alias("low"), "close",
                     "volume", "asset_tag", "trading_session")


def test_first_22_bars_dropped(spark):
    closes = [100 + (i % 5) for i in range(30)]
    bars = _bars(spark, closes)
    news = spark.createDataFrame([("X", D(2024, 2, 28), 0.1, 1.0, "Direct", 0.0)], NEWS_SCHEMA)
    f = FE.build_features(bars, news).orderBy("trading_session").collect()
    assert f[0].trading_session == D(2024, 1, 23)        # row 23 is the first kept
    assert len(f) == 30 - 22


def test_zero_volume_and_nonpositive_close(spark):
    from sentibar.operators.bars import price_features
    bars = _bars(spark, [10, -1, 12, 13], vols=[0, 5, 5, 5])
    r = price_features(bars).orderBy("trading_session").collect()
    assert r[1].vol_roc_1d is None                      # previous volume 0
    assert r[1].log_return_1d is None and r[2].log_return_1d is None


def test_coverage_guard_and_assets_without_news(spark):
    bars = _bars(spark, [100 + i for i in range(40)]).unionByName(
        _bars(spark, [50 + i for i in range(40)], asset="Y"))
    news = spark.createDataFrame([("X", D(2024, 1, 30), 0.1, 1.0, "Direct", 0.0)], NEWS_SCHEMA)
    f = FE.build_features(bars, news).collect()
    assert {r.asset_tag for r in f} == {"X"}
    assert max(r.trading_session for r in f) == D(2024, 1, 30)
    last = [r for r in f if r.trading_session == D(2024, 1, 30)][0]
    assert last.next_day_abs_return is None              # next row is beyond the guard


def test_null_prediction_and_constant_returns(spark):
    rows = [("X", D(2024, 1, i), 0.01, None if i == 2 else 0.02) for i in range(1, 6)]
    p = spark.createDataFrame(rows, "asset_tag string, trading_session date, log_return_1d double, pred double")
    c = BT.equity_curves(BT.to_long(p, {"M": "pred"})).filter(F.col("model") == "M") \
        .orderBy("trading_session").collect()
    assert c[1].position is None and c[2].strat_return == 0.0   # lag of NULL position -> 0
    m = {r.model: r for r in BT.strategy_metrics(
        BT.equity_curves(BT.to_long(p, {"M": "pred"}))).collect()}
    assert m[BT.BUY_AND_HOLD].sharpe == 0.0              # constant returns


def test_sequences_need_40_rows(spark):
    def n_seq(k):
        df = spark.createDataFrame([("X", D(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(k)],
                                   "asset_tag string, trading_session date, v double")
        return ST.lookback_sequences(df, ["v"], "v").count()
    assert n_seq(39) == 0
    assert n_seq(40) == 10


def test_first_file_wins_and_tags(spark):
    df = spark.createDataFrame([("t", "b.json", 0, "late"), ("t", "a.json", 5, "early")],
                               "headline string, _file string, _pos long, body string")
    assert K.first_wins(df, "headline", ["_file", "_pos"]).collect()[0].body == "early"
    from sentibar.sources.io import flatten_tags
    tags = spark.createDataFrame([('["a","b"]',), ("x",), (None,)], "tags string")
    assert [r.t for r in tags.select(flatten_tags(F.col("tags")).alias("t")).collect()] == ["a|b", "x", ""]


def test_reply_json_variants(spark):
    df = spark.createDataFrame([
        ('Sure: {"asset": "A", "sentiment_score": 0.5, "impact_type": "Direct"} thanks',),
        ("no json here",), ('{"asset": "A", "sentiment_score": 0.5',)], "reply string")
    f = TX.reply_fields(TX.reply_object("reply"))
    out = df.select(f["sentiment_score"].alias("s"), f["asset"].alias("a")).collect()
    assert out[0].s == 0.5 and out[0].a == "A"
    assert out[1].s is None and out[2].s is None


def test_clean_html_rules(spark):
    df = spark.createDataFrame([("<p>a &amp;lt; b</p><script>x<y</script><!-- c -->  d\n e",), (None,)],
                               "h string")
    out = [r.t for r in df.select(TX.clean_html("h").alias("t")).collect()]
    assert out == ["a &lt; b d e", None]


def test_clip_keeps_null(spark):
    from sentibar.functions.numeric import clip
    df = spark.createDataFrame([(None,), (0.2,), (0.001,)], "x double")
    assert [r.c for r in df.select(clip("x", 0.005, 0.1).alias("c")).collect()] == [None, 0.1, 0.005]


def test_external_batch_scorer_and_rescore(spark):
    import pandas as pd
    from sentibar.operators import scoring as SC

    def model(texts: pd.Series) -> pd.DataFrame:
        # Toy batch model: long texts are positive with prob 0.9.
        long = texts.str.len() > 5
        return pd.DataFrame({"label": long.map({True: "positive", False: "neutral"}),
                             "prob": 0.9})

    df = spark.createDataFrame([(1, "short", None), (2, "a longer text", None), (3, "x", 0.25)],
                               "id int, text string, score double")
    scored = SC.score_articles(df, F.col("text"), SC.pandas_scorer(model), prefix="m")
    got = {r.id: (r.m_label, r.m_sentiment) for r in scored.collect()}
    assert got[2] == ("positive", 0.9) and got[1] == ("neutral", 0.0)
    res = {r.id: r.score for r in SC.rescore_pending(df, F.col("text"), "score",
                                                       SC.pandas_scorer(model)).collect()}
    assert res == {1: 0.0, 2: 0.9, 3: 0.25}              # only pending rows are scored


def test_rescoring_null_and_repeated_keys(spark):
    from sentibar.operators import scoring as SC
    df = spark.createDataFrame([(None, "good gain", None), (7, "bad loss", None), (7, "good", None), (8, "x", 0.5)],
                               "id int, text string, score double")
    out = sorted((r.text, r.score is not None) for r in SC.rescore_pending(df, F.col("text"), "score").collect())
    assert out == [("bad loss", True), ("good", True), ("good gain", True), ("x", True)]


def test_repeated_updates_do_not_multiply_rows(spark):
    target = spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, v double")
    updates = spark.createDataFrame([(1, 5.0, 2), (1, 9.0, 1)], "k int, v double, o int")
    assert sorted(tuple(r) for r in K.keyed_update(target, updates, "k", ["v"], order="o").collect()) == [(1, 9.0), (2, 0.0)]
    assert sorted(tuple(r) for r in K.keyed_update(target, updates, "k", ["v"]).collect()) == [(1, 5.0), (2, 0.0)]


def test_references_and_spaces(spark):
    cases = [("&rsquo;&#8217;&#x2019;&ndash;&eacute;", "\u2019\u2019\u2019\u2013\u00e9"), ("&amp;lt; &nope; &copy", "&lt; &nope; \u00a9"),
             ("a\u2003b\u3000c\u0085d", "a b c d"), ('<a title="x > y">t</a>', "t"), ("<b x='>'>z <i", "z <i"),
             ("&#0;&#55296;&#x110000;&#150;", "\ufffd\ufffd\ufffd\u2013"), ("", ""), ("AT&T & co", "AT&T & co")]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    assert [r.t for r in df.orderBy("i").select(TX.clean_html("h").alias("t")).collect()] == [w for _, w in cases]


def test_reply_strictness(spark):
    cases = [('{"asset": "A", "asset": "B", "sentiment_score": "0.25"}', ("B", 0.25)), ('{"asset": "A"} {"asset": "B"}', (None, None)),
             ('{"asset": "A"},{"asset": "B"}', (None, None)), ("{'asset': 'A'}", (None, None)), (None, (None, None)),
             ('pre {"asset": null, "sentiment_score": 1e-2} post', (None, 0.01))]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, reply string")
    v = df.withColumn("_v", TX.reply_object("reply")).withColumns(TX.reply_fields("_v"))
    assert [(r.asset, r.sentiment_score) for r in v.orderBy("i").collect()] == [w for _, w in cases]


def test_tolerant_times(spark):
    import datetime as dt
    from sentibar.functions.times import parse_time
    t = dt.datetime
    cases = [("2024-01-05T10:00:00Z", t(2024, 1, 5, 10)), ("January 5, 2024", t(2024, 1, 5)), ("05 Jan 2024 10:00", t(2024, 1, 5, 10)),
             ("Fri, 05 Jan 2024 10:00:00 +0200", t(2024, 1, 5, 8)), ("2024/01/05", t(2024, 1, 5)), ("1/5/2024 12:30 AM", t(2024, 1, 5, 0, 30)),
             ("Jan 5, 2024 at 3:04 pm", t(2024, 1, 5, 15, 4)), ("20240105", t(2024, 1, 5)), ("2024-01-05T10:00:00.123-05:00", t(2024, 1, 5, 15, 0, 0, 123000)),
             ("2024-13-05", None), ("2024-01-05 25:00", None), ("n/a", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s string")
    assert [r.p for r in df.orderBy("i").select(parse_time("s").alias("p")).collect()] == [w for _, w in cases]


def test_impact_types_come_from_the_data(spark):
    import datetime as dt
    from sentibar.operators import sentiment as SE
    d = dt.date(2024, 1, 5)
    rows = [("A", d, "direct", 0.5), ("A", d, "Direct", 0.1), ("A", d, "Macro", -1.0), ("B", d, None, 0.3)]
    news = spark.createDataFrame(rows, "asset_tag string, trading_session date, gemma_impact_type string, gemma_sentiment_score double")
    r = SE.impact_pivot(news).collect()
    assert len(r) == 1 and r[0].direct_mean_score == 0.3 and r[0].macro_mean_score == -1.0


def test_missing_close_is_carried_forward(spark):
    import datetime as dt
    from sentibar.operators import bars as BA
    d = [dt.date(2024, 1, i) for i in range(1, 5)]
    rows = [("A", d[0], 10.0), ("A", d[1], None), ("A", d[2], 20.0), ("B", d[0], 5.0), ("B", d[3], 6.0)]
    bars = spark.createDataFrame(rows, "asset_tag string, trading_session date, close double")
    got = {(r.asset_tag, r.trading_session.day): r.rebased for r in BA.rebased_prices(bars).collect()}
    assert got[("A", 2)] == 100.0 and got[("A", 3)] == 200.0 and got[("A", 4)] == 200.0 and got[("B", 3)] == 100.0


def test_ingest_end_to_end(spark):
    import datetime as dt
    from sentibar.operators import ingest as IN
    from sentibar.sources import fixtures as FX
    rows = [(1, "NVDA", "up", "January 5, 2024 22:00", "s", "<p>a &amp; b</p>", 0), (2, "NVDA", "up", "2024-01-05T22:30:00Z", "x", "late", 1),
            (3, "EGX", "eg", "2024-01-04 15:00:00", None, None, 2), (4, "NVDA", "", "2024-01-05", "s", "c", 3), (5, "NVDA", "old", "2019-01-05", "s", "c", 4),
            (6, "XAU", "gold", "05 Jan 2024 22:00", "s", "c", 5), (7, "USO", "bad", "n/a", "s", "c", 6)]
    raw = spark.createDataFrame(rows, "id long, asset_tag string, headline string, raw_time string, summary string, content string, o int")
    cal = FX.session_calendar(spark, ranges=(("2023-12-01", "2024-02-29"),))
    t = dt.datetime
    got = {r.news_id: (r.time, r.content) for r in IN.ingest_news(raw, cal, "o").collect()}
    assert got == {1: (t(2024, 1, 8, 9, 30), "a & b"), 3: (t(2024, 1, 7, 10, 0), None), 6: (t(2024, 1, 5, 22, 0), "c")}
