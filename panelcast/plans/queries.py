"""Registered queries: one per operator of the inventory, over the derived views.

Every query reads the input tables of ``sf_dir`` (through ``RetailData``) and
runs over all of them; the DuckDB oracle for each lives in
``panelcast.checks.oracle`` under the same name.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.models.naive import lag_forecast, lagged_paths
from panelcast.operators import eda, features, fills, joins, metrics, reshape
from panelcast.plans.data import RetailData
from panelcast.plans.registry import register, round_doubles
from panelcast.session import scratch_path
from panelcast.sources import files
from panelcast.sources.fixtures import SNAP_MAP

TEST_DAYS = 28
TOP_N = 50
FC_KEEP = ("item_id", "store_id", "cat_id")


def _d(spark: SparkSession, sf_dir: str) -> RetailData:
    return RetailData(spark, sf_dir)


def _dated_sales(d: RetailData) -> DataFrame:
    return joins.attach_date(d.sales_long(), d.calendar())


SERIES_KEYS = ("item_id", "store_id")


def _forecast(d: RetailData, lag: int = 28, keep=FC_KEEP) -> DataFrame:
    """Seasonal-naive forecast of the test window. The window runs on the
    panel's own key (item_id, store_id), reusing the panel's partitioning;
    unique_id is only an output column."""
    extra = [c for c in keep if c not in SERIES_KEYS]
    series = reshape.to_series_frame(d.panel(), keep=[*SERIES_KEYS, *extra])
    fc = lag_forecast(series, d.cutoff(TEST_DAYS), lag, keys=SERIES_KEYS,
                      keep=["unique_id", *extra])
    return fc.select("unique_id", *keep, "ds", "y", "yhat")


def _scale(d: RetailData) -> DataFrame:
    """RMSSE scale per series from the training history, computed on the
    panel's key (no re-shuffle of the history), then keyed by unique_id."""
    hist = d.panel().where(F.col("date") < F.lit(d.cutoff(TEST_DAYS)))
    sc = metrics.series_scale(hist, SERIES_KEYS, "date", "sales")
    return sc.select(F.concat_ws("_", *SERIES_KEYS).alias("unique_id"), "scale")


# ---------------------------------------------------------------- sources / sinks
@register("scan_sales")
def q_scan_sales(spark, sf_dir):
    d = _d(spark, sf_dir)
    path = scratch_path(spark, "sales_wide_csv")
    files.save_csv(d.sales_wide(), path)
    return reshape.melt_sales(files.load_sales(spark, path))


@register("scan_calendar")
def q_scan_calendar(spark, sf_dir):
    d = _d(spark, sf_dir)
    path = scratch_path(spark, "calendar_csv")
    files.save_csv(d.calendar(), path)
    return files.load_calendar(spark, path)


@register("scan_prices")
def q_scan_prices(spark, sf_dir):
    d = _d(spark, sf_dir)
    path = scratch_path(spark, "prices_csv")
    files.save_csv(d.prices(), path)
    return files.load_prices(spark, path)


@register("sink_roundtrip")
def q_sink_roundtrip(spark, sf_dir):
    d = _d(spark, sf_dir)
    path = scratch_path(spark, "sales_long_parquet")
    long = d.sales_long()
    files.save_table(long, path, ["store_id"])
    return files.load_table(spark, path, long.schema)


# ---------------------------------------------------------------- reshapes / filters
@register("melt_sales")
def q_melt_sales(spark, sf_dir):
    return reshape.melt_sales(_d(spark, sf_dir).sales_wide())


@register("filter_store_cat")
def q_filter_store_cat(spark, sf_dir):
    d = _d(spark, sf_dir)
    first3 = [r[0] for r in d.sales_sparse().select("store_id").distinct().orderBy("store_id").take(3)]
    return reshape.filter_in(_dated_sales(d), store_id=first3, cat_id=[]).select(
        "item_id", "store_id", "cat_id", "date", "sales")


@register("filter_dates")
def q_filter_dates(spark, sf_dir):
    d = _d(spark, sf_dir)
    lo = d.last_day - dt.timedelta(days=364)
    return reshape.filter_dates(_dated_sales(d), lo, d.last_day).select(
        "item_id", "store_id", "date", "sales")


@register("filter_options")
def q_filter_options(spark, sf_dir):
    return reshape.filter_options(_dated_sales(_d(spark, sf_dir)))


@register("split_train")
def q_split_train(spark, sf_dir):
    d = _d(spark, sf_dir)
    return reshape.train_test_split(d.panel(), TEST_DAYS, max_date=d.last_day)[0]


@register("split_test")
def q_split_test(spark, sf_dir):
    d = _d(spark, sf_dir)
    return reshape.train_test_split(d.panel(), TEST_DAYS, max_date=d.last_day)[1]


@register("split_valid_flag")
def q_split_valid_flag(spark, sf_dir):
    d = _d(spark, sf_dir)
    train = reshape.train_test_split(d.panel(), TEST_DAYS, max_date=d.last_day)[0]
    last_train = d.cutoff(TEST_DAYS) - dt.timedelta(days=1)
    return reshape.validation_flag(train, 28, max_date=last_train).select(
        "item_id", "store_id", "date", "is_valid")


@register("drop_null_target")
def q_drop_null_target(spark, sf_dir):
    merged = _d(spark, sf_dir).merged(fill=False)
    return reshape.drop_null_target(merged, "sell_price").select(
        "item_id", "store_id", "d", "sell_price")


@register("to_series_frame")
def q_to_series_frame(spark, sf_dir):
    return reshape.to_series_frame(_d(spark, sf_dir).panel())


@register("clip_nonneg")
def q_clip_nonneg(spark, sf_dir):
    """Clip a forecast that can go negative: yhat = 2*lag7 - lag14 (linear trend)."""
    d = _d(spark, sf_dir)
    series = reshape.to_series_frame(d.panel(), keep=SERIES_KEYS)
    origin = F.date_sub(F.lit(d.cutoff(TEST_DAYS)), 1)
    y7, y14 = (fills.lag_from(F.col("y"), k, origin, TEST_DAYS, SERIES_KEYS) for k in (7, 14))
    raw = series.select("unique_id", "ds", (2 * y7 - y14).alias("raw")).where(F.col("ds") >= F.lit(d.cutoff(TEST_DAYS)))
    return raw.withColumn("yhat", reshape.clip_nonneg("raw"))


@register("residuals")
def q_residuals(spark, sf_dir):
    fc = _forecast(_d(spark, sf_dir), 28, ())
    fc = fc.select("unique_id", "ds", F.col("y").alias("actual"), F.col("yhat").alias("predicted"))
    return reshape.residuals(fc)


@register("encode_categories")
def q_encode_categories(spark, sf_dir):
    d = _d(spark, sf_dir)
    return reshape.encode_categories(
        d.sales_long().select("item_id", "store_id", "d", "cat_id", "dept_id"),
        ["cat_id", "dept_id"], vocab_source=d.sales_sparse())


# ---------------------------------------------------------------- joins
@register("join_calendar")
def q_join_calendar(spark, sf_dir):
    d = _d(spark, sf_dir)
    return joins.join_calendar(d.sales_long(), d.calendar())


@register("join_prices")
def q_join_prices(spark, sf_dir):
    d = _d(spark, sf_dir)
    m = d.merged(fill=False)
    return m.select("item_id", "store_id", "d", "wm_yr_wk", "sell_price")


@register("merge_all")
def q_merge_all(spark, sf_dir):
    return _d(spark, sf_dir).panel(late=True)


@register("top_items")
def q_top_items(spark, sf_dir):
    return joins.top_items(_d(spark, sf_dir).sales_long(), TOP_N)


@register("keep_top_items")
def q_keep_top_items(spark, sf_dir):
    """Top-10 items kept by semi join (the top-N operator itself is the feature)."""
    return joins.keep_top_items(_d(spark, sf_dir).sales_long(), 10)


@register("attach_date")
def q_attach_date(spark, sf_dir):
    return _dated_sales(_d(spark, sf_dir))


@register("join_actual_pred")
def q_join_actual_pred(spark, sf_dir):
    d = _d(spark, sf_dir)
    test = reshape.to_series_frame(d.panel()).where(F.col("ds") >= F.lit(d.cutoff(TEST_DAYS)))
    pred = _forecast(d, 28, ()).select("unique_id", "ds", "yhat")
    return joins.join_actual_pred(test, pred)


# ---------------------------------------------------------------- fills
@register("fill_prices")
def q_fill_prices(spark, sf_dir):
    merged = _d(spark, sf_dir).merged(fill=False)
    return fills.fill_prices(merged).select("item_id", "store_id", "date", "sell_price")


@register("fill_missing")
def q_fill_missing(spark, sf_dir):
    merged = _d(spark, sf_dir).merged(fill=False)
    return fills.fill_missing(merged).select(
        "item_id", "store_id", "date", "sales", "event_name_1", "event_type_1",
        "event_name_2", "event_type_2")


@register("null_audit")
def q_null_audit(spark, sf_dir):
    d = _d(spark, sf_dir)
    before = fills.null_audit(d.merged(fill=False, late=True), "before")
    after = fills.null_audit(d.panel(late=True), "after")
    return before.unionByName(after)


# ---------------------------------------------------------------- aggregates
@register("item_totals")
def q_item_totals(spark, sf_dir):
    return joins.item_totals(_d(spark, sf_dir).sales_long())


@register("daily_totals")
def q_daily_totals(spark, sf_dir):
    return eda.daily_totals(_dated_sales(_d(spark, sf_dir)))


@register("store_totals")
def q_store_totals(spark, sf_dir):
    return eda.store_totals(_d(spark, sf_dir).sales_long())


@register("category_share")
def q_category_share(spark, sf_dir):
    return eda.category_share(_d(spark, sf_dir).sales_long())


@register("seasonality_dow")
def q_seasonality_dow(spark, sf_dir):
    return eda.seasonality(_dated_sales(_d(spark, sf_dir)), "dow")


@register("seasonality_month")
def q_seasonality_month(spark, sf_dir):
    return eda.seasonality(_dated_sales(_d(spark, sf_dir)), "month")


@register("correlation_matrix")
def q_correlation_matrix(spark, sf_dir):
    return eda.correlation_matrix(_d(spark, sf_dir).panel())


# ---------------------------------------------------------------- metrics
def _per_series_metric(spark, sf_dir, expr_fn, name):
    fc = _forecast(_d(spark, sf_dir), 28, ())
    return fc.groupBy("unique_id").agg(F.round(expr_fn(), 4).alias(name))


@register("m_rmse")
def q_m_rmse(spark, sf_dir):
    return _per_series_metric(spark, sf_dir, metrics.rmse_expr, "RMSE")


@register("m_mae")
def q_m_mae(spark, sf_dir):
    return _per_series_metric(spark, sf_dir, metrics.mae_expr, "MAE")


@register("m_mape")
def q_m_mape(spark, sf_dir):
    return _per_series_metric(spark, sf_dir, metrics.mape_expr, "MAPE")


@register("m_smape")
def q_m_smape(spark, sf_dir):
    return _per_series_metric(spark, sf_dir, metrics.smape_expr, "sMAPE")


@register("m_rmsse")
def q_m_rmsse(spark, sf_dir):
    from panelcast.plans.flagship import forecast_and_scale
    d = _d(spark, sf_dir)
    pred, scale = forecast_and_scale(d.panel(), d.cutoff(TEST_DAYS), (28,))
    out = metrics.rmsse_per_series(pred, scale)
    return out.select("unique_id", F.round("RMSSE", 4).alias("RMSSE"))


@register("m_wrmsse")
def q_m_wrmsse(spark, sf_dir):
    """WRMSSE with dollar-sales weights (last 28 training days); forecasts,
    scales and weights all come from one window pass over the panel."""
    from panelcast.plans.flagship import forecast_and_scale
    d = _d(spark, sf_dir)
    pred, scale = forecast_and_scale(d.panel(), d.cutoff(TEST_DAYS), (28,), weight_days=28)
    fc = pred.join(scale.select("unique_id", "weight"), "unique_id", "left")
    return metrics.evaluate_all(fc, [], scale.select("unique_id", "scale"),
                                weight="weight").select("WRMSSE")


@register("evaluate_all")
def q_evaluate_all(spark, sf_dir):
    from panelcast.plans.flagship import forecast_and_scale
    d = _d(spark, sf_dir)
    pred, scale = forecast_and_scale(d.panel(), d.cutoff(TEST_DAYS), (28,))
    return metrics.evaluate_all(pred, ["store_id"], scale)


@register("m_card_metrics")
def q_m_card_metrics(spark, sf_dir):
    fc = _forecast(_d(spark, sf_dir), 28, ())
    daily = fc.groupBy("ds").agg(F.sum("y").alias("actual"), F.sum("yhat").alias("predicted"))
    return metrics.card_metrics(daily)


# ---------------------------------------------------------------- features
def _event_types(d: RetailData) -> list[str]:
    """Event-type vocabulary for the one-hot columns, read from the calendar
    (one row per day) instead of a distinct over the whole panel."""
    return features.event_type_values(d.calendar())



def _panel_with(spark, sf_dir, fn, *args) -> DataFrame:
    return fn(_d(spark, sf_dir).panel(), *args)


@register("feat_lags")
def q_feat_lags(spark, sf_dir):
    return _panel_with(spark, sf_dir, features.add_lag_features).select(
        "item_id", "store_id", "date", "sales", "lag_7", "lag_14", "lag_28", "lag_90", "lag_365")


@register("feat_rolling")
def q_feat_rolling(spark, sf_dir):
    df = _panel_with(spark, sf_dir, features.add_rolling_features)
    return df.select("item_id", "store_id", "date", "sales",
                     *[c for c in df.columns if c.startswith("rolling_")])


@register("feat_calendar")
def q_feat_calendar(spark, sf_dir):
    return _panel_with(spark, sf_dir, lambda p: features.add_calendar_features(p.select(*SERIES_KEYS, "date")))


@register("feat_price")
def q_feat_price(spark, sf_dir):
    return _panel_with(spark, sf_dir, features.add_price_features).select(
        "item_id", "store_id", "date", "sell_price", "price_change", "price_momentum",
        "price_norm", "price_std")


@register("feat_events")
def q_feat_events(spark, sf_dir):
    d = _d(spark, sf_dir)
    df = features.add_event_features(d.panel(), _event_types(d), snap_map=SNAP_MAP)
    return df.select("item_id", "store_id", "date", "has_event", "snap",
                     *[c for c in df.columns if c.startswith("event_type_") and c[-1] != "1"
                       and c[-1] != "2"])


@register("build_features")
def q_build_features(spark, sf_dir):
    d = _d(spark, sf_dir)
    return features.build_features(d.panel(), event_types=_event_types(d), snap_map=SNAP_MAP)


# ---------------------------------------------------------------- leaderboard family
BOARD_LAGS = (7, 14, 28)


def _board_parts(d: RetailData, lags=BOARD_LAGS):
    """Three seasonal-naive forecasters (lag 7, 14, 28) as one long frame, and
    the RMSSE scale, from a single window pass over the panel (one shuffle)."""
    from panelcast.plans.flagship import forecast_and_scale
    return forecast_and_scale(d.panel(), d.cutoff(TEST_DAYS), lags, keep=("cat_id",))


def _board_forecasts(d: RetailData) -> DataFrame:
    return _board_parts(d)[0]


def _board(d: RetailData) -> DataFrame:
    pred, scale = _board_parts(d)
    scores = metrics.evaluate_all(pred, ["model"], scale)
    # naive forecasters have nothing to train
    return scores.select(F.col("model").alias("Model"), *metrics.METRICS,
                         F.lit(0.0).alias("train_seconds"))


@register("leaderboard")
def q_leaderboard(spark, sf_dir):
    return metrics.leaderboard(_board(_d(spark, sf_dir)))


@register("melt_metrics")
def q_melt_metrics(spark, sf_dir):
    return reshape.melt_metrics(_board(_d(spark, sf_dir)))


@register("best_per_metric")
def q_best_per_metric(spark, sf_dir):
    return metrics.best_per_metric(reshape.melt_metrics(_board(_d(spark, sf_dir))))


@register("radar_scores")
def q_radar_scores(spark, sf_dir):
    return metrics.radar_scores(reshape.melt_metrics(_board(_d(spark, sf_dir))))


@register("metrics_json")
def q_metrics_json(spark, sf_dir):
    path = scratch_path(spark, "metrics_json")
    files.save_metrics_json(_board(_d(spark, sf_dir)), path)
    return files.load_metrics(spark, json_dir=path)


@register("leaderboard_csv")
def q_leaderboard_csv(spark, sf_dir):
    """The leaderboard exported as CSV and read back; the CSV wins over the JSON folder."""
    path = scratch_path(spark, "leaderboard_csv")
    files.save_csv(metrics.leaderboard(_board(_d(spark, sf_dir))).coalesce(1), path)
    return files.load_metrics(spark, csv_path=path, json_dir=f"{path}-json")


@register("leaderboard_by_mae")
def q_leaderboard_by_mae(spark, sf_dir):
    """The leaderboard under another sort key, with the place of each model (one row per model)."""
    board = metrics.leaderboard(_board(_d(spark, sf_dir)), "MAE")
    return board.withColumn("place", F.row_number().over(Window.orderBy("MAE", "Model")))


@register("insights_roundtrip")
def q_insights_roundtrip(spark, sf_dir):
    """Insight tables written as one dataset each, one of them read back."""
    folder = scratch_path(spark, "insights")
    series = reshape.to_series_frame(_d(spark, sf_dir).panel())
    acf_rows = eda.acf(series, nlags=40)
    files.save_insights({"acf": acf_rows, "series": series.groupBy("unique_id").agg(F.count("*").alias("n"))}, folder)
    return files.load_insight(spark, folder, "acf")


@register("forecast_fallback")
def q_forecast_fallback(spark, sf_dir):
    """The first location that exists of an ordered list of forecast folders."""
    path = scratch_path(spark, "forecast_fallback")
    files.save_table(_forecast(_d(spark, sf_dir), 28, ()), path)
    return files.load_first(spark, [f"{path}-newer", f"{path}-new", path])


@register("forecast_files")
def q_forecast_files(spark, sf_dir):
    """Daily forecasts of three models in three formats; of each folder the first candidate that exists is read: the CSV,
    where it is missing the Parquet file, where that is missing too the file beside the folder."""
    d = _d(spark, sf_dir)
    fc = _board_forecasts(d).checkpoint()   # read once per file
    folder, out = scratch_path(spark, "forecast_files"), None
    for skipped, name in enumerate(("all", "no_csv", "old_only")):
        places = files.forecast_files(f"{folder}/{name}", "Lag")
        for place, model in list(zip(places, BOARD_LAGS))[skipped:]:
            files.save_forecast_file(files.daily_forecast(fc.where(F.col("model") == f"lag_{model}"), metrics.BAND_PCT["gbt"]), place)
        got = files.load_forecast_file(spark, f"{folder}/{name}", "Lag").withColumn("folder", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


@register("sales_files")
def q_sales_files(spark, sf_dir):
    """Long sales from each candidate in turn: processed Parquet (all items), processed CSV (one category), the raw wide
    file (another), the wide file beside it (the third)."""
    d = _d(spark, sf_dir)
    wide = d.sales_wide().checkpoint()   # written to four places
    long = reshape.melt_sales(wide)
    of = lambda df, k: df.where(F.col("cat_id") == f"CAT_{k}")
    folder, out = scratch_path(spark, "sales_files"), None
    for skipped, name in enumerate(("parquet", "csv", "raw", "beside")):
        base = f"{folder}/{name}"
        writes = [lambda: files.save_table(long, f"{base}/processed/sales_long.parquet"),
                  lambda: files.save_csv(of(long, 0), f"{base}/processed/sales_long.csv"),
                  lambda: files.save_csv(of(wide, 1), f"{base}/raw/{files.SALES_FILE}"),
                  lambda: files.save_csv(of(wide, 2), f"{base}/{files.SALES_FILE}")]
        for write in writes[skipped:]:
            write()
        got = files.load_sales_long(spark, base).groupBy("item_id", "store_id", "cat_id").agg(
            F.count("*").alias("days"), F.sum("sales").alias("sales")).withColumn("folder", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


@register("model_vs_benchmark")
def q_model_vs_benchmark(spark, sf_dir):
    pred, scale = _board_parts(_d(spark, sf_dir), (7, 28))
    return metrics.model_vs_benchmark(pred, "lag_7", "lag_28", "cat_id", scale)


# ---------------------------------------------------------------- forecast post-processing
@register("pct_band")
def q_pct_band(spark, sf_dir):
    return metrics.pct_band(_forecast(_d(spark, sf_dir), 28, ()), metrics.BAND_PCT["gbt"])


@register("forecast_total")
def q_forecast_total(spark, sf_dir):
    return metrics.forecast_total(_forecast(_d(spark, sf_dir), 28, ()))


@register("forecast_scaled")
def q_forecast_scaled(spark, sf_dir):
    d = _d(spark, sf_dir)
    n_total = d.sales_sparse().select("item_id", "store_id").distinct().count()
    return metrics.forecast_scaled(_forecast(d, 28, ()), n_total)


def _paths(d: RetailData) -> DataFrame:
    return lagged_paths(reshape.to_series_frame(d.panel()), d.cutoff(TEST_DAYS))


@register("path_quantiles")
def q_path_quantiles(spark, sf_dir):
    return eda.path_quantiles(_paths(_d(spark, sf_dir)))


@register("static_features")
def q_static_features(spark, sf_dir):
    series = reshape.to_series_frame(_d(spark, sf_dir).panel(),
                                     keep=["dept_id", "cat_id", "state_id"])
    return eda.static_features(series, ["dept_id", "cat_id", "state_id"])


@register("series_list")
def q_series_list(spark, sf_dir):
    """The first 5 series in key order (the listing's k is the feature)."""
    return eda.series_list(_d(spark, sf_dir).sales_long(), k=5)


@register("residual_histogram")
def q_residual_histogram(spark, sf_dir):
    fc = _forecast(_d(spark, sf_dir), 28, ())
    res = reshape.residuals(fc.select("unique_id", "ds", F.col("y").alias("actual"),
                                      F.col("yhat").alias("predicted")))
    return metrics.residual_histogram(res)


@register("union_train_test")
def q_union_train_test(spark, sf_dir):
    d = _d(spark, sf_dir)
    tr, te = reshape.train_test_split(d.panel(), TEST_DAYS, max_date=d.last_day)
    return tr.unionByName(te).select("item_id", "store_id", "date", "sales")


@register("future_dates")
def q_future_dates(spark, sf_dir):
    from panelcast.models.common import future_dates
    return future_dates(reshape.to_series_frame(_d(spark, sf_dir).panel()), 28)


@register("regressor_means")
def q_regressor_means(spark, sf_dir):
    d = _d(spark, sf_dir)
    train = reshape.to_series_frame(d.panel(), keep=["sell_price"]).where(
        F.col("ds") < F.lit(d.cutoff(TEST_DAYS)))
    return joins.regressor_means(train, ["sell_price"])


@register("future_regressors")
def q_future_regressors(spark, sf_dir):
    """Test-window dates per series; prices are known for even weeks only, elsewhere the
    series' training mean stands in: a window on the panel's own key, no join."""
    d = _d(spark, sf_dir)
    known = F.when(F.col("wm_yr_wk") % 2 == 0, F.col("sell_price"))
    return joins.future_from_panel(d.panel(), d.cutoff(TEST_DAYS), {"sell_price": known})


# ---------------------------------------------------------------- grids and decomposition
def _sparse_series(d: RetailData) -> DataFrame:
    sp = joins.attach_date(d.sales_sparse(), d.calendar())
    return reshape.to_series_frame(sp)


@register("densify_zero")
def q_densify_zero(spark, sf_dir):
    return fills.densify_zero(_sparse_series(_d(spark, sf_dir)))


@register("densify_ffill")
def q_densify_ffill(spark, sf_dir):
    d = _d(spark, sf_dir)
    sp = joins.attach_date(d.sales_sparse(), d.calendar())
    per_store = sp.groupBy("store_id", "date").agg(F.sum("sales").cast("double").alias("sales"))
    return fills.densify_ffill(per_store, ["store_id"], "date", "sales")


@register("seasonal_decompose")
def q_seasonal_decompose(spark, sf_dir):
    daily = eda.daily_totals(_dated_sales(_d(spark, sf_dir)))
    return eda.seasonal_decompose(fills.densify_ffill(daily, [], "date", "sales"))


@register("acf")
def q_acf(spark, sf_dir):
    return eda.acf(reshape.to_series_frame(_d(spark, sf_dir).panel()), nlags=40)


@register("pacf")
def q_pacf(spark, sf_dir):
    acf_rows = eda.acf(reshape.to_series_frame(_d(spark, sf_dir).panel()), nlags=40)
    return eda.pacf(acf_rows)


# ---------------------------------------------------------------- forecasters
def _train_series(d: RetailData, keep=()) -> DataFrame:
    """Training part as (unique_id, item_id, store_id, ds, y, ...), every day; the panel
    key is kept so grouped fits reuse the panel's partitioning."""
    series = reshape.to_series_frame(d.panel(gaps=False), keep=[*SERIES_KEYS, *keep])
    return series.where(F.col("ds") < F.lit(d.cutoff(TEST_DAYS)))


@register("fc_seasonal_ar")
def q_fc_seasonal_ar(spark, sf_dir):
    """Seasonal autoregression of every series by normal equations, 28 days ahead."""
    from panelcast.models.lag_regression import forecast
    return forecast(_train_series(_d(spark, sf_dir)).drop("unique_id"), 28, keys=SERIES_KEYS)


@register("fc_paths")
def q_fc_paths(spark, sf_dir):
    from panelcast.models.paths import forecast_paths
    return forecast_paths(_train_series(_d(spark, sf_dir)), 28, 20, keys=SERIES_KEYS)


@register("fc_paths_samples")
def q_fc_paths_samples(spark, sf_dir):
    from panelcast.models.paths import forecast_paths
    return forecast_paths(_train_series(_d(spark, sf_dir)), 28, 20, keys=SERIES_KEYS,
                          return_samples=True)


def _arima(d: RetailData, orders=None) -> DataFrame:
    """The model table of the training part: one row per series."""
    from panelcast.models import arima
    return arima.fit(_train_series(d).drop("unique_id"), orders or [arima.Order()], keys=SERIES_KEYS)


@register("fc_arima")
def q_fc_arima(spark, sf_dir):
    """(1,1,1)(1,0,0,7) for every series, with 95 % intervals; what can't be fitted is a row with its status."""
    from panelcast.models import arima
    return arima.forecast(_arima(_d(spark, sf_dir)), TEST_DAYS, keys=SERIES_KEYS).drop("error")


@register("arima_orders")
def q_arima_orders(spark, sf_dir):
    """The AIC of 48 orders for every series, all from one Gram matrix per series; the chosen one marked."""
    from panelcast.models import arima
    return arima.order_scores(_arima(_d(spark, sf_dir), arima.SEARCH), SERIES_KEYS)


@register("fc_arima_auto")
def q_fc_arima_auto(spark, sf_dir):
    """Forecasts at each series' own chosen order: per series its dates and whether the intervals hold the forecasts."""
    from panelcast.models import arima
    fc = arima.forecast(_arima(_d(spark, sf_dir), arima.SEARCH), TEST_DAYS, keys=SERIES_KEYS)
    return fc.groupBy("unique_id", "status").agg(
        F.count("*").alias("n"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.bool_and((F.col("yhat_lower") >= 0) & (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("ordered"))


@register("arima_roundtrip")
def q_arima_roundtrip(spark, sf_dir):
    """The fitted table saved, loaded, and forecast from without the history."""
    from panelcast.models import arima, store
    path = scratch_path(spark, "arima_model")
    store.save(_arima(_d(spark, sf_dir)), path, arima.KIND)
    return arima.forecast(store.load(spark, path, arima.KIND), TEST_DAYS, keys=SERIES_KEYS).drop("error")


ADDITIVE_REGRESSORS = ("sell_price", "snap")


def _additive(d: RetailData) -> DataFrame:
    """The additive model of the training part, price and the state's SNAP flag as regressors."""
    from panelcast.models import additive
    panel = d.panel(gaps=False).withColumn("snap", _snap())
    series = reshape.to_series_frame(panel, keep=[*SERIES_KEYS, "sell_price", "snap"])
    train = series.where(F.col("ds") < F.lit(d.cutoff(TEST_DAYS))).drop("unique_id")
    return additive.fit(train, d.calendar(), SERIES_KEYS, regressors=ADDITIVE_REGRESSORS)


def _additive_columns(d: RetailData) -> dict:
    """What ``_additive`` models have for holidays and regressors, read from the calendar (not from a fit)."""
    from panelcast.models import additive
    return {"names": additive.holiday_names(d.calendar()), "regressors": ADDITIVE_REGRESSORS}


#: Digits that the additive model's queries keep: its normal equations are worse conditioned than sums and means.
ADDITIVE_DIGITS = 3


@register("fc_additive", rounded=False)
def q_fc_additive(spark, sf_dir):
    from panelcast.models import additive
    d = _d(spark, sf_dir)
    return round_doubles(additive.forecast(_additive(d), d.calendar(), TEST_DAYS, keys=SERIES_KEYS, **_additive_columns(d)).drop("error"), ADDITIVE_DIGITS)


@register("additive_components", rounded=False)
def q_additive_components(spark, sf_dir):
    """Trend, weekly, yearly, holiday and regressor parts of each forecast day; ``adds_up``: they sum to the uncut forecast."""
    from panelcast.models import additive
    d = _d(spark, sf_dir)
    out = additive.components(_additive(d), d.calendar(), TEST_DAYS, keys=SERIES_KEYS, **_additive_columns(d))
    parts = ["trend", "weekly", "yearly", "holidays", "part_sell_price", "part_snap"]
    adds = F.abs(sum((F.col(p) for p in parts), F.lit(0.0)) - F.col("yhat")) < 1e-6 * (1 + F.abs(F.col("yhat")))
    return round_doubles(out.select("unique_id", "ds", *parts, adds.alias("adds_up")), ADDITIVE_DIGITS)


@register("additive_changepoints", rounded=False)
def q_additive_changepoints(spark, sf_dir):
    from panelcast.models import additive
    return round_doubles(additive.changepoints(_additive(_d(spark, sf_dir)), SERIES_KEYS), ADDITIVE_DIGITS)


# ---------------------------------------------------------------- global models
# One fitted model per session and state of the input files (names, sizes, times): the gbt_* queries
# share a fit of up to several hundred rounds, and changed data or a new session fits anew.
_FITTED: dict[tuple, object] = {}


def _features(d: RetailData) -> DataFrame:
    """Features on train and test stacked, so lags cross the split boundary; every day."""
    return features.build_features(d.panel(gaps=False), event_types=_event_types(d), snap_map=SNAP_MAP)


def _gbt(d: RetailData):
    from panelcast.models.gbt import gbt_fit
    tables = ("lineitem", "part", "supplier", "nation", "region")
    listing = tuple(files.listing(d.spark, f"{d.sf_dir.rstrip('/')}/{t}.parquet") for t in tables)
    key = (d.spark.sparkContext.applicationId, d.sf_dir.rstrip("/"), listing)
    if key not in _FITTED:
        _FITTED.clear()
        train = _features(d).where(F.col("date") < F.lit(d.cutoff(TEST_DAYS)))
        _FITTED[key] = gbt_fit(train, "sales")
    return _FITTED[key]


@register("gbt_fit")
def q_gbt_fit(spark, sf_dir):
    """The fitted model on its validation window: rows, and whether it beats forecasting nothing and the training mean there."""
    from panelcast.models.gbt import ROUNDS
    d = _d(spark, sf_dir)
    m = _gbt(d)
    train = _features(d).where(F.col("date") < F.lit(d.cutoff(TEST_DAYS)))
    last_train, mean = train.agg(F.max("date"), F.avg("sales")).first()
    val = train.where(F.col("date") >= F.lit(last_train - dt.timedelta(days=27)))
    pred = m.predict(val)
    mse = F.avg(F.pow(F.col("sales") - F.col("yhat"), 2))
    return pred.agg(F.count("*").alias("val_rows"), (mse < F.avg(F.pow("sales", 2))).alias("beats_zero"),
                    (mse < F.avg(F.pow(F.col("sales") - F.lit(float(mean)), 2))).alias("beats_mean"),
                    F.lit(1 <= m.model.stages[-1].getNumTrees <= ROUNDS).alias("within_rounds"))


def _test_features(d: RetailData) -> DataFrame:
    return _features(d).where(F.col("date") >= F.lit(d.cutoff(TEST_DAYS)))


@register("gbt_evaluate")
def q_gbt_evaluate(spark, sf_dir):
    """One-step predictions of the test window: per series its rows, actuals, and whether all
    predictions are demand (not NULL, not negative)."""
    from panelcast.models.gbt import gbt_evaluate
    d = _d(spark, sf_dir)
    return gbt_evaluate(_gbt(d), _test_features(d)).groupBy("unique_id").agg(
        F.count("*").alias("n"), F.sum("y").alias("y"), F.bool_and(F.coalesce(F.col("yhat") >= 0, F.lit(False))).alias("nonneg"))


@register("gbt_importance")
def q_gbt_importance(spark, sf_dir):
    imp = _gbt(_d(spark, sf_dir)).importance(None)
    return imp.agg((F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"), F.bool_and(F.col("importance") >= 0).alias("nonneg"),
                   ((F.sum("splits") > 0) & F.bool_and((F.col("splits") > 0) == (F.col("importance") > 0))).alias("splits_counted"))


INSIGHT_COLUMNS = ("lag_7", "rolling_mean_28", "sell_price", "day_of_week", "snap")


@register("insight_tables")
def q_insight_tables(spark, sf_dir):
    """Covariate weights (by permutation on the validation days), components and changepoints written as one table each and
    read back: the rows of each, and whether weights are a share, parts sum up and knots lie inside their series."""
    from panelcast.models import additive
    from panelcast.models.importance import permutation_importance
    d = _d(spark, sf_dir)
    model, cut = _gbt(d), d.cutoff(TEST_DAYS)
    val = _features(d).where((F.col("date") < F.lit(cut)) & (F.col("date") >= F.date_sub(F.lit(cut), 28)))
    weights = permutation_importance(model.predict, val, "sales", INSIGHT_COLUMNS, (*SERIES_KEYS, "date"))
    fitted = _additive(d).checkpoint()   # read for both tables
    folder = scratch_path(spark, "insight_tables")
    files.save_insights({"covariate_weights": weights, "changepoints": additive.changepoints(fitted, SERIES_KEYS),
                         "components": additive.components(fitted, d.calendar(), TEST_DAYS, keys=SERIES_KEYS)}, folder)
    read = lambda name: files.load_insight(spark, folder, name)
    parts = ["trend", "weekly", "yearly", "holidays", "part_sell_price", "part_snap"]
    sound = {"covariate_weights": F.bool_and(F.col("weight").between(0, 1)) & (F.abs(F.sum("weight") - 1) < 1e-9),
             "components": F.bool_and(F.abs(sum((F.col(p) for p in parts), F.lit(0.0)) - F.col("yhat")) < 1e-6 * (1 + F.abs(F.col("yhat")))),
             "changepoints": F.bool_and(F.col("delta").isNotNull() & (F.col("ds") < F.lit(cut)))}
    out = [read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), ok.alias("sound")) for name, ok in sound.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("fc_gbt_recursive")
def q_fc_gbt_recursive(spark, sf_dir):
    """28 dependent steps from every series' own last training day: per series the dates
    reached and whether all forecasts are demand."""
    return _horizon_rows(_gbt_recursive(_d(spark, sf_dir)))


def _gbt_recursive(d: RetailData, horizon: int = TEST_DAYS) -> DataFrame:
    from panelcast.models.gbt import recursive_forecast
    hist = _features(d).where(F.col("date") < F.lit(d.cutoff(TEST_DAYS)))
    return recursive_forecast(_gbt(d), hist, _known_future(d), horizon, event_cols={"snap": _snap()})


def _known_future(d: RetailData) -> DataFrame:
    return features.add_event_features(d.calendar(), _event_types(d), snap_map=None).drop("month", "year")


def _snap():
    """The SNAP flag of the row's own state, from the calendar's columns."""
    snap = None
    for state, col in SNAP_MAP.items():
        cond = F.col("state_id") == state
        val = F.coalesce(F.col(col).cast("int"), F.lit(0))
        snap = F.when(cond, val) if snap is None else snap.when(cond, val)
    return snap.otherwise(F.lit(0))


def _horizon_rows(fc: DataFrame) -> DataFrame:
    return fc.groupBy("unique_id").agg(
        F.count("*").alias("n"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.bool_and(F.coalesce(F.col("yhat") >= 0, F.lit(False))).alias("nonneg"))


def _direct_series(d: RetailData) -> DataFrame:
    """Series frame with event/SNAP flags and category codes, every day; keeps the panel's
    (item_id, store_id) so the windows downstream reuse its partitioning. The
    code vocabularies come from the sparse facts (a one-column distinct)."""
    ev = features.add_event_features(d.panel(gaps=False), event_types=[], snap_map=SNAP_MAP)
    series = reshape.to_series_frame(ev, keep=[*SERIES_KEYS, "has_event", "snap", "cat_id", "dept_id", "state_id"])
    return reshape.encode_categories(series, ["cat_id", "dept_id"], vocab_source=d.sales_sparse())


@register("direct_training_rows")
def q_direct_training_rows(spark, sf_dir):
    from panelcast.models.direct import direct_training_rows
    d = _d(spark, sf_dir)
    last_train = d.cutoff(TEST_DAYS) - dt.timedelta(days=1)
    return direct_training_rows(_direct_series(d), last_train, TEST_DAYS, ["cat_id", "dept_id"],
                                partition=SERIES_KEYS).drop(*SERIES_KEYS)


@register("fc_direct")
def q_fc_direct(spark, sf_dir):
    return _horizon_rows(_direct(_d(spark, sf_dir)))


def _direct(d: RetailData, horizon: int = TEST_DAYS) -> DataFrame:
    from panelcast.models.direct import direct_forecast
    last_train = d.cutoff(TEST_DAYS) - dt.timedelta(days=1)
    known = _known_future(d).withColumnRenamed("date", "ds")
    return direct_forecast(_direct_series(d), last_train, horizon, ["cat_id", "dept_id"], partition=SERIES_KEYS,
                           calendar=known, event_cols={"snap": _snap()}, carry=["state_id"])


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """Save the fitted global model, load it back: both predict the same test window."""
    from panelcast.models.gbt import gbt_evaluate, load_model, save_model
    d = _d(spark, sf_dir)
    path = scratch_path(spark, "gbt_model")
    save_model(_gbt(d), path)
    test = _test_features(d).checkpoint()
    both = gbt_evaluate(load_model(spark, path), test).join(
        gbt_evaluate(_gbt(d), test).select("unique_id", "ds", F.col("yhat").alias("own")), ["unique_id", "ds"])
    return both.groupBy("unique_id").agg(F.count("*").alias("n"), F.sum("y").alias("y"),
                                         F.bool_and(F.col("yhat") == F.col("own")).alias("equal"))


@register("run_models")
def q_run_models(spark, sf_dir):
    """Four models timed, scored against all actuals and ranked: two seasonal-naive ones, one that
    forecasts only some series, and one that fails. All forecast from the written training frame."""
    from panelcast.models.runner import default_models, run_models
    d = _d(spark, sf_dir)
    series, cut = reshape.to_series_frame(d.panel(gaps=False)), d.cutoff(TEST_DAYS)
    naive = default_models()

    def broken(train, h):
        raise ArithmeticError("no solution")

    models = {"lag_7": naive["naive_7"], "lag_28": naive["naive_28"], "broken": broken,
              "half": lambda train, h: naive["naive_28"](train, h).where(F.col("unique_id").endswith("A_1"))}
    board = run_models(series.where(F.col("ds") < F.lit(cut)), series.where(F.col("ds") >= F.lit(cut)), models, TEST_DAYS).board
    return board.select("Model", "n_series", "n_scored", "n_failed", "complete", "failed", "RMSE", "MAE", "rank")


def _per_series_models(d: RetailData) -> dict:
    from panelcast.models import additive, arima, lag_regression
    names = additive.holiday_names(d.calendar())
    return {"seasonal_ar": lag_regression.forecast, "arima": lambda train, h: arima.forecast(arima.fit(train), h),
            "additive": lambda train, h: additive.forecast(additive.fit(train, d.calendar()), d.calendar(), h, names=names, regressors=[])}


@register("run_models_all")
def q_run_models_all(spark, sf_dir):
    """All forecasters: naive, sample paths, seasonal autoregression, seasonal ARIMA, the additive model, and the global direct and
    recursive models; none reads the test window's sales. What each covered, and whether it was ranked."""
    from panelcast.models.runner import default_models, run_models
    d = _d(spark, sf_dir)
    series, cut = reshape.to_series_frame(d.panel(gaps=False)), d.cutoff(TEST_DAYS)
    global_models = {**_per_series_models(d), "gbt": lambda train, h: _gbt_recursive(d, h), "direct": lambda train, h: _direct(d, h)}
    res = run_models(series.where(F.col("ds") < F.lit(cut)), series.where(F.col("ds") >= F.lit(cut)),
                     default_models(global_models), TEST_DAYS)
    scored = F.coalesce(F.col("RMSE") >= 0, F.lit(False)).alias("scored")
    return res.board.select("Model", "n_series", "n_scored", "n_failed", "complete", "failed", F.col("rank").isNotNull().alias("ranked"), scored)


@register("run_failures")
def q_run_failures(spark, sf_dir):
    """Every (model, series) that a model did not simply fit: too short, constant, without a forecast, or a model that raised."""
    from panelcast.models.runner import default_models, run_models
    d = _d(spark, sf_dir)
    series, cut = reshape.to_series_frame(d.panel(gaps=False)), d.cutoff(TEST_DAYS)

    def broken(train, h):
        raise ArithmeticError("no solution")

    models = {"paths": default_models()["paths"], **_per_series_models(d), "broken": broken}
    res = run_models(series.where(F.col("ds") < F.lit(cut)), series.where(F.col("ds") >= F.lit(cut)), models, TEST_DAYS)
    return res.failures.select("model", "unique_id", "status")


@register("alignment_report")
def q_alignment_report(spark, sf_dir):
    """Actuals of the test window vs forecasts issued for the last 35 days."""
    d = _d(spark, sf_dir)
    series = reshape.to_series_frame(d.panel())
    actual = series.where(F.col("ds") >= F.lit(d.cutoff(TEST_DAYS)))
    pred = lag_forecast(series, d.cutoff(TEST_DAYS + 7), 28, horizon=TEST_DAYS + 7)
    return metrics.alignment_report(actual, pred)


@register("load_all")
def q_load_all(spark, sf_dir):
    """Write the three retail files into one folder, load them together, and
    run the preprocessing on them (melt, top-N, joins, fills); the train part."""
    from panelcast.plans.preprocess import preprocess
    d = _d(spark, sf_dir)
    folder = scratch_path(spark, "retail_folder")
    files.save_csv(d.sales_wide(), f"{folder}/{files.SALES_FILE}")
    files.save_csv(d.calendar(), f"{folder}/{files.CALENDAR_FILE}")
    files.save_csv(d.prices(), f"{folder}/{files.PRICES_FILE}")
    sales, cal, prices = files.load_all(spark, folder)
    train, _ = preprocess(sales, cal, prices, top_n=TOP_N, test_days=TEST_DAYS, wide=True)
    return train.select("item_id", "store_id", "date", "sales", "sell_price")


@register("preprocess_test")
def q_preprocess_test(spark, sf_dir):
    from panelcast.plans.preprocess import preprocess
    d = _d(spark, sf_dir)
    _, test = preprocess(d.sales_long(), d.calendar(), d.prices(), top_n=TOP_N, test_days=TEST_DAYS)
    return test


@register("preprocess_train")
def q_preprocess_train(spark, sf_dir):
    from panelcast.plans.preprocess import preprocess
    d = _d(spark, sf_dir)
    train, _ = preprocess(d.sales_long(), d.calendar(), d.prices(), top_n=TOP_N,
                          test_days=TEST_DAYS)
    return train


@register("forecast_sink")
def q_forecast_sink(spark, sf_dir):
    """All forecasters' outputs written as one dataset partitioned by model;
    one model read back (partition pruning on ``model``)."""
    d = _d(spark, sf_dir)
    path = scratch_path(spark, "forecasts")
    fc = _board_forecasts(d).select("model", "unique_id", "ds", "y", "yhat")
    files.save_forecasts(fc, path)
    return files.load_forecast(spark, path, "lag_7").drop("model")
