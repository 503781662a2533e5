"""Hand-made frames per operator (edge cases from the fixture list)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import eda, features, fills, joins, metrics, reshape

D0 = dt.date(2016, 1, 1)


def days(n, start=D0):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_lags_and_rolling_one_row(spark):
    df = spark.createDataFrame([("a", "s", D0, 5)], "item_id string, store_id string, date date, sales int")
    out = features.add_rolling_features(features.add_lag_features(df)).first()
    assert out["lag_7"] is None
    assert out["rolling_mean_7"] is None and out["rolling_std_7"] is None


def test_rolling_excludes_current_row(spark):
    rows = [("a", "s", d, i) for i, d in enumerate(days(10))]
    df = spark.createDataFrame(rows, "item_id string, store_id string, date date, sales int")
    out = {r["date"]: r for r in features.add_rolling_features(df, [3]).collect()}
    r = out[D0 + dt.timedelta(days=5)]
    assert r["rolling_mean_3"] == pytest.approx((2 + 3 + 4) / 3)
    assert r["rolling_min_3"] == 2 and r["rolling_max_3"] == 4
    assert out[D0 + dt.timedelta(days=1)]["rolling_mean_3"] == 0.0  # one period is enough


def test_no_leakage_from_future_values(spark):
    rows = [("a", "s", d, i % 5) for i, d in enumerate(days(60))]
    df = spark.createDataFrame(rows, "item_id string, store_id string, date date, sales int")
    changed = df.withColumn("sales", F.when(F.col("date") == D0 + dt.timedelta(days=40), 999)
                            .otherwise(F.col("sales")))
    cols = ["lag_7", "lag_14", "rolling_mean_7", "rolling_std_28", "rolling_max_14"]

    def feats(x):
        out = features.add_rolling_features(features.add_lag_features(x, [7, 14]))
        return {r["date"]: tuple(r[c] for c in cols) for r in out.collect()}

    a, b = feats(df), feats(changed)
    for d in days(41):
        assert a[d] == b[d]


def test_price_fill_all_null_and_leading_null(spark):
    schema = "item_id string, store_id string, date date, sell_price double"
    rows = [("a", "s", d, None) for d in days(5)]
    rows += [("b", "s", d, p) for d, p in zip(days(5), [None, None, 2.0, None, 3.0])]
    out = {(r["item_id"], r["date"]): r["sell_price"]
           for r in fills.fill_prices(spark.createDataFrame(rows, schema)).collect()}
    assert all(out[("a", d)] == 0.0 for d in days(5))
    assert [out[("b", d)] for d in days(5)] == [2.0, 2.0, 2.0, 2.0, 3.0]


def test_price_features_edge_values(spark):
    schema = "item_id string, store_id string, date date, sell_price double"
    rows = [("a", "s", d, 0.0) for d in days(5)]
    out = features.add_price_features(spark.createDataFrame(rows, schema)).collect()
    assert all(r["price_norm"] == 1.0 and r["price_change"] == 0.0 for r in out)
    assert all(r["price_std"] == 0.0 for r in out)


def test_metrics_zero_actuals(spark):
    df = spark.createDataFrame([("u", D0, 0.0, 0.0), ("u", D0, 0.0, 0.0), ("u", D0, 0.0, 0.0),
                                ("u", D0, 0.0, 0.0)], "unique_id string, ds date, y double, yhat double")
    r = df.agg(metrics.mape_expr().alias("m"), metrics.smape_expr().alias("s")).first()
    assert r["m"] is None and r["s"] == 0.0


def test_rmsse_flat_series_floor(spark):
    hist = spark.createDataFrame([("u", d, 3.0) for d in days(10)], "unique_id string, ds date, y double")
    pred = spark.createDataFrame([("u", D0 + dt.timedelta(days=20), 3.0, 4.0)],
                                 "unique_id string, ds date, y double, yhat double")
    r = metrics.evaluate_all(pred, [], metrics.series_scale(hist), digits=None).first()
    assert r["WRMSSE"] == pytest.approx(math.sqrt(1.0 / 1e-8))
    assert r["RMSE"] == 1.0 and r["MAE"] == 1.0


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 5, 50).astype(float), rng.normal(2, 1, 50)
    df = spark.createDataFrame([("u", D0 + dt.timedelta(days=i), float(a), float(b))
                                for i, (a, b) in enumerate(zip(y, p))],
                               "unique_id string, ds date, y double, yhat double")
    r = metrics.evaluate_all(df, [], digits=None).first()
    m = y != 0
    assert r["RMSE"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert r["MAE"] == pytest.approx(np.mean(np.abs(y - p)))
    assert r["MAPE"] == pytest.approx(np.mean(np.abs((y[m] - p[m]) / y[m])) * 100)
    scale = np.mean(np.diff(y) ** 2)
    assert r["WRMSSE"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2) / scale))


def test_top_items_tie_break(spark):
    rows = [("b", "s", "d_1", 5), ("a", "s", "d_1", 5), ("c", "s", "d_1", 9), ("d", "s", "d_1", 1)]
    df = spark.createDataFrame(rows, "item_id string, store_id string, d string, sales int")
    assert [r["item_id"] for r in joins.top_items(df, 2).collect()] == ["c", "a"]
    assert sorted(r["item_id"] for r in joins.keep_top_items(df, 2).collect()) == ["a", "c"]


def test_densify_zero_and_ffill(spark):
    df = spark.createDataFrame([("u", D0, 1.0), ("u", D0 + dt.timedelta(days=2), 3.0),
                                ("u", D0 + dt.timedelta(days=5), 6.0)], "unique_id string, ds date, y double")
    z = [r["y"] for r in fills.densify_zero(df).orderBy("ds").collect()]
    assert z == [1.0, 0.0, 3.0, 0.0, 0.0, 6.0]
    f = [r["y"] for r in fills.densify_ffill(df, ["unique_id"], "ds", "y").orderBy("ds").collect()]
    assert f == [1.0, 1.0, 3.0, 3.0, 3.0, 6.0]


def test_calendar_edge_dates(spark):
    ds = [dt.date(2016, 1, 1), dt.date(2016, 1, 31), dt.date(2016, 2, 29), dt.date(2016, 12, 31)]
    df = spark.createDataFrame([(d,) for d in ds], "date date")
    out = {r["date"]: r for r in features.add_calendar_features(df).collect()}
    assert out[ds[0]]["week_of_year"] == 53 and out[ds[0]]["day_of_week"] == 4
    assert out[ds[1]]["is_month_end"] == 1 and out[ds[2]]["is_month_end"] == 1
    assert out[ds[3]]["is_weekend"] == 1 and out[ds[0]]["is_month_start"] == 1


def test_train_test_split_disjoint_and_whole(spark):
    df = spark.createDataFrame([("a", d, 1) for d in days(40)], "item_id string, date date, sales int")
    tr, te = reshape.train_test_split(df, 28)
    assert tr.count() == 12 and te.count() == 28
    assert tr.agg(F.max("date")).first()[0] < te.agg(F.min("date")).first()[0]


def test_melt_is_inverse_of_pivot(spark):
    wide = spark.createDataFrame([("x_s", "x", "d", "c", "s", "t", 1, 2, 0)],
                                 "id string, item_id string, dept_id string, cat_id string, "
                                 "store_id string, state_id string, d_1 short, d_2 short, d_3 short")
    long = reshape.melt_sales(wide)
    assert sorted((r["d"], r["sales"]) for r in long.collect()) == [("d_1", 1), ("d_2", 2), ("d_3", 0)]
    back = long.groupBy("item_id").pivot("d", ["d_1", "d_2", "d_3"]).agg(F.first("sales")).first()
    assert (back["d_1"], back["d_2"], back["d_3"]) == (1, 2, 0)


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(float(i), 2.0, float(2 * i)) for i in range(10)], "a double, b double, c double")
    out = {(r["col_a"], r["col_b"]): r["corr"] for r in eda.correlation_matrix(df).collect()}
    assert out[("a", "b")] is None and out[("b", "b")] is None
    assert out[("a", "c")] == pytest.approx(1.0)


def test_decomposition_parts_sum(spark):
    vals = [10 + 0.1 * i + [3, 1, 0, -1, -2, 0, 5][i % 7] for i in range(70)]
    df = spark.createDataFrame([(d, v) for d, v in zip(days(70), vals)], "date date, sales double")
    out = eda.seasonal_decompose(df).collect()
    assert len(out) == 64
    for r in out:
        assert r["trend"] + r["seasonal"] + r["resid"] == pytest.approx(r["observed"])


def test_acf_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    df = spark.createDataFrame([("u", d, float(v)) for d, v in zip(days(200), x)],
                               "unique_id string, ds date, y double")
    got = {r["lag"]: r["acf"] for r in eda.acf(df, nlags=5).collect()}
    dxx = x - x.mean()
    for k in range(6):
        assert got[k] == pytest.approx(np.sum(dxx[k:] * dxx[:len(x) - k]) / np.sum(dxx * dxx))


def test_result_independent_of_partitions(spark):
    rows = [("a" if i % 2 else "b", "s", d, i % 7) for i, d in enumerate(days(100))]
    df = spark.createDataFrame(rows, "item_id string, store_id string, date date, sales int")
    results = []
    for n in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out = features.build_features(df.repartition(n), lags=[1, 7], windows=[3])
        results.append(sorted(tuple(r) for r in out.select("item_id", "date", "lag_7", "rolling_mean_3")
                              .collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_one_pass_price_fill_equals_join_then_fill(spark):
    """The union + window price attach equals a left join followed by the fills,
    including leading gaps, a series without prices and price weeks outside
    the series' range."""
    rng = np.random.default_rng(11)
    sales, prices = [], []
    for item in ("a", "b", "c"):
        for i, d in enumerate(days(60)):
            sales.append((item, "s", d, 100 + i // 7, int(rng.integers(0, 5))))
    for wk in range(95, 112):            # weeks 95-99 and 109-111 lie outside 100..108
        if rng.random() < 0.5:
            prices.append(("a", "s", wk, float(rng.integers(1, 9))))
        if wk in (104, 105):
            prices.append(("b", "s", wk, float(wk)))
    s = spark.createDataFrame(sales, "item_id string, store_id string, date date, wm_yr_wk int, sales int")
    p = spark.createDataFrame(prices, "item_id string, store_id string, wm_yr_wk int, sell_price double")
    one = fills.attach_prices_filled(s, p)
    two = fills.fill_prices(joins.join_prices(s, p))
    key = ["item_id", "date"]
    a = sorted((r["item_id"], r["date"], r["sell_price"]) for r in one.select(*key, "sell_price").collect())
    b = sorted((r["item_id"], r["date"], r["sell_price"]) for r in two.select(*key, "sell_price").collect())
    assert a == b
    assert one.count() == s.count()


def test_one_pass_price_fill_with_a_gap(spark):
    """A price of a week without a sales row isn't carried on."""
    from panelcast.operators.fills import attach_prices_filled
    sales = spark.createDataFrame([("a", "s", dt.date(2020, 1, 1), 1), ("a", "s", dt.date(2020, 1, 15), 3)],
                                  "item_id string, store_id string, date date, wm_yr_wk int")
    prices = spark.createDataFrame([("s", "a", 1, 10.0), ("s", "a", 2, 99.0)],
                                   "store_id string, item_id string, wm_yr_wk int, sell_price double")
    got = [r["sell_price"] for r in attach_prices_filled(sales, prices).orderBy("date").collect()]
    assert got == [10.0, 10.0]


def test_split_date_comes_from_the_sales(spark):
    """A calendar that runs on past the sales leaves the test window full."""
    from panelcast.plans.preprocess import preprocess
    d0 = dt.date(2020, 1, 1)
    cal = spark.createDataFrame([(d0 + dt.timedelta(days=i), f"d_{i + 1}", 1 + i // 7) for i in range(128)],
                                "date date, d string, wm_yr_wk int")
    prices = spark.createDataFrame([("s", "a", 1, 2.0)], "store_id string, item_id string, wm_yr_wk int, sell_price double")
    long = spark.createDataFrame([("a", "s", f"d_{i + 1}", i) for i in range(100)], "item_id string, store_id string, d string, sales int")
    wide = spark.createDataFrame([("a_s", "a", "s", *range(100))],
                                 "id string, item_id string, store_id string, " + ", ".join(f"d_{i + 1} int" for i in range(100)))
    for sales, is_wide in ((long, False), (wide, True)):
        train, test = preprocess(sales, cal, prices, top_n=None, wide=is_wide)
        assert (train.count(), test.count()) == (72, 28)


def test_no_local_checkpoint_folder_on_a_cluster():
    from panelcast.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
