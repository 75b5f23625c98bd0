"""Registered queries: source/sink round trips through shared storage.

These write files while the plan is built, as a sink does; reading back is
lazy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.numeric import add_column_if_absent
from ..operators import backtest as BT
from ..operators import features as FE
from ..operators import keys as K
from ..operators import pages as PG
from ..operators import volmodels as VM
from ..sources import fixtures as FX
from ..sources import io as IO
from ..sources import json_splits as JS
from . import q_text  # noqa: F401 - the page record twin
from .catalog import register
from .oracle import cte
from .q_models import NAIVE_MODELS, naive_predictions

ROWS_PER_FILE = 50   # bound on the rows gathered into one JSON array file


@register("csv_roundtrip", ops="A1 A2 A7 A10",
          sql="SELECT time, symbol, open, high, low, close, volume FROM bars",
          ctes=("bars",), rnd=("open", "high", "low", "close", "volume"), dates=("time",))
def q_csv(t):
    """Bars delivered twice, the second time with lower prices: the first row of
    the first file wins."""
    path = IO.scratch_path(t.spark, "bars-csv")
    bars = FX.bars_from_lineitem(t.lineitem)
    IO.write_bars_csv(bars, f"{path}/delivery=0")
    IO.write_bars_csv(bars.withColumns({c: F.col(c) - 1 for c in ("open", "close")}), f"{path}/delivery=1")
    back = IO.read_bars_csv_ordered(t.spark, path)
    return K.insert_ignore(None, back, ["time", "symbol"], IO.FILE_ORDER).drop(*IO.FILE_ORDER)


def _article_files(t):
    """Page records written as JSON array files (one per id bucket), plus an
    empty file and an undecodable one, as a scraper output folder looks."""
    path = IO.scratch_path(t.spark, "articles-json")
    rec = PG.page_fields(t.pages).withColumn("day", F.floor(F.col("page_id") / ROWS_PER_FILE))
    rec = rec.withColumn("tags", F.split("tags", r"\|"))
    IO.write_json_arrays(rec, path, "day", order="page_id")
    t.spark.createDataFrame([("[]",)], "value string").coalesce(1).write.text(f"{path}/day=empty")
    t.spark.createDataFrame([('[{"title": "x",',)], "value string").coalesce(1).write.text(
        f"{path}/day=broken")
    return path


# Files in path order (day=1/ before day=10/), records in file order.
cte("page_files", """  SELECT *, CAST(page_id // 50 AS VARCHAR) || '/' AS file FROM page_record WHERE title <> ''""",
    "page_record")


@register("json_merge_roundtrip", ops="A4 A5 A6 B1 B22 B23 D23 G2",
          sql="""SELECT title AS headline, arg_min(r.lead, r.k) AS summary, arg_min(r.body, r.k) AS content,
       CAST(NULL AS VARCHAR) AS raw_time, arg_min(r.tags, r.k) AS tags, arg_min(r.category, r.k) AS category,
       arg_min(r.author, r.k) AS author, arg_min(r.provider, r.k) AS provider, arg_min(r.url, r.k) AS url
FROM (SELECT title, (file, page_id) AS k, coalesce(nullif(lead, ''), '~') AS lead, coalesce(nullif(body, ''), '~') AS body,
             tags, category, author, provider, url FROM page_files) r GROUP BY title""",
          ctes=("page_files",), dates=())
def q_json(t):
    path = _article_files(t)
    raw = IO.normalise_articles(IO.read_json_articles(t.spark, path))
    kept = K.first_wins(raw.filter(F.col("headline").isNotNull()), "headline", ["_file", "_pos"])
    out = IO.scratch_path(t.spark, "articles-merged")
    cols = ["headline", "summary", "content", "raw_time", "tags", "category", "author", "provider", "url"]
    IO.write_json_lines(kept.select(*cols), out)
    back = t.spark.read.schema(", ".join(f"{c} string" for c in cols)).json(out)
    return back.fillna("~", subset=["summary", "content"])


_SPLIT_COLS = ["title", "lead", "body", "category", "author", "provider", "url"]


@register("json_splits", ops="A4 A5",
          sql="SELECT title, lead, body, category, author, provider, url FROM page_record", ctes=("page_record",), dates=())
def q_json_splits(t):
    """All page records as JSON array files, one for each partition, read by byte range."""
    path = IO.scratch_path(t.spark, "articles-arrays")
    rows = PG.page_fields(t.pages).select(F.to_json(F.struct(*_SPLIT_COLS)).alias("value"))
    JS.write_json_arrays_streamed(rows, path)
    return JS.read_json_splits(t.spark, path).select(*_SPLIT_COLS)


@register("merge_file_stats", ops="D24 A5",
          sql="""SELECT (SELECT count(DISTINCT page_id // 50) FROM pages) + 2 AS files_scanned,
       CAST(1 AS BIGINT) AS empty_files, CAST(1 AS BIGINT) AS invalid_files,
       count(DISTINCT title) AS unique_records, count(*) - count(DISTINCT title) AS duplicates
FROM page_files""", ctes=("page_files",), dates=())
def q_file_stats(t):
    path = _article_files(t)
    stats = IO.file_stats(t.spark, path)
    raw = IO.normalise_articles(IO.read_json_articles(t.spark, path)).filter(F.col("headline").isNotNull())
    per_title = raw.groupBy("headline").agg(F.count(F.lit(1)).alias("_c"))
    return stats.agg(F.count(F.lit(1)).alias("files_scanned"),
                     F.sum(F.col("empty").cast("int")).alias("empty_files"),
                     F.sum(F.col("invalid").cast("int")).alias("invalid_files")).select(
        "*", per_title.agg(F.count(F.lit(1))).scalar().alias("unique_records"),
        per_title.agg(F.sum("_c") - F.count(F.lit(1))).scalar().alias("duplicates"))


@register("table_versions", ops="A9 A10 A11 A12 A15 H8",
          sql="SELECT f.*, g.e AS garch_residual FROM features f LEFT JOIN gresid g USING (asset_tag, trading_session)",
          ctes=("features", "gresid"), dates=("time", "trading_session"),
          rnd=("open", "high", "low", "close", "volume", "log_return_1d", "log_return_3d", "log_return_5d",
               "realized_vol_22d", "vol_roc_1d", "finbert_mean", "gemma_mean", "gemma_dispersion",
               "gemma_conf_weighted", "article_impact_index", "direct_mean_score", "indirect_mean_score",
               "none_mean_score", "direct_impact_index", "indirect_impact_index", "none_impact_index",
               "sentiment_persistence_3d", "next_day_abs_return", "garch_residual"))
def q_tables(t):
    f = FE.build_features(FX.bars_from_lineitem(t.lineitem), FX.news_from_orders(t.orders))
    path = IO.scratch_path(t.spark, "model-features")
    v1 = IO.replace_table(f, path)
    v1 = add_column_if_absent(v1, "garch_residual", "double")
    r = VM.residual_series(v1).select("asset_tag", "trading_session", F.col("e").alias("garch_residual"))
    v2 = K.keyed_update(v1, r, ["asset_tag", "trading_session"], ["garch_residual"])
    v2 = IO.replace_table(v2, IO.scratch_path(t.spark, "model-features-v2"))
    assert IO.describe(v2).count() == len(v2.columns)
    return v2


def _metrics_sql(hybrid: str | None) -> str:
    """The strategy table over naive predictions, restated."""
    models = [("Buy & Hold", "NULL"), ("Naive Lagged Vol", "naive_lag_vol"), ("Realized Vol", "realized_vol_22d")]
    models += [("Hybrid", hybrid)] if hybrid else []
    rows = " UNION ALL ".join(f"SELECT asset_tag, trading_session, log_return_1d AS r, '{m}' AS model, "
                              f"CAST({c} AS DOUBLE) AS pred FROM preds" for m, c in models)
    w = "PARTITION BY asset_tag, model ORDER BY trading_session"
    return f"""WITH p AS ({rows}),
pos AS (SELECT *, CASE WHEN pred IS NOT NULL THEN greatest(least(0.01 / greatest(least(pred, 0.1), 0.005), 2.0), 0.0) END AS q FROM p),
st AS (SELECT *, CASE WHEN model = 'Buy & Hold' THEN r ELSE coalesce(lag(q) OVER ({w}) * r, 0.0) END AS s FROM pos),
eq AS (SELECT *, product(1.0 + s) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM st),
dd AS (SELECT *, e / max(e) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM eq)
SELECT asset_tag, model, CASE WHEN stddev_samp(s) = 0 THEN 0.0 ELSE sqrt(252.0) * avg(s) / stddev_samp(s) END AS sharpe,
       min(d) AS max_drawdown, count(*) AS n FROM dd GROUP BY asset_tag, model"""


@register("optional_table_fallback", ops="A20 C4", sql=_metrics_sql("realized_vol_22d"), ctes=("preds",),
          rnd=("sharpe", "max_drawdown"), dates=())
def q_optional(t):
    return _with_hybrid(t, IO.scratch_path(t.spark, "dl-predictions"))


def _with_hybrid(t, path: str):
    preds = naive_predictions(t)
    table = IO.read_optional(t.spark, path)
    if table is None:
        preds = preds.withColumn("hybrid_pred", F.col("realized_vol_22d"))
    else:
        preds = preds.join(table, ["trading_session", "asset_tag"], "left")
    return BT.vol_target_backtest(preds, {**NAIVE_MODELS, "Hybrid": "hybrid_pred"})


@register("optional_table_present", ops="A20 C4 A9", sql=_metrics_sql("naive_lag_vol * 1.5"), ctes=("preds",),
          rnd=("sharpe", "max_drawdown"), dates=())
def q_optional_present(t):
    path = IO.scratch_path(t.spark, "dl-predictions")
    IO.replace_table(naive_predictions(t).select("trading_session", "asset_tag",
                                                 (F.col("naive_lag_vol") * 1.5).alias("hybrid_pred")), path)
    return _with_hybrid(t, path)


@register("metrics_sink", ops="A8 A7",
          sql="SELECT asset_tag, model, sharpe, max_drawdown, 0.01 AS target_vol FROM ("
              + _metrics_sql(None) + ")", ctes=("preds",), rnd=("sharpe", "max_drawdown", "target_vol"), dates=())
def q_metrics_sink(t):
    m = BT.vol_target_backtest(naive_predictions(t), NAIVE_MODELS)
    path = IO.scratch_path(t.spark, "backtest-results")
    m.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    m.write.mode("overwrite").parquet(f"{path}/parquet")
    back = t.spark.read.parquet(f"{path}/parquet")
    return back.select("asset_tag", "model", "sharpe", "max_drawdown",
                       F.lit(FV.TARGET_DAILY_VOL).alias("target_vol"))
