"""Plans that must not grow a task with the tables."""

import datetime as dt
import re

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F


def test_partitions_of_the_panel_follow_its_rows(spark, monkeypatch):
    from panelcast.plans import data, queries  # noqa: F401
    from panelcast.plans.registry import QUERIES
    plain = data.RetailData(spark, SF_SMALL)
    assert plain.partitions is None and plain.rows >= plain.panel().count()
    before = {tuple(r) for r in QUERIES["clip_nonneg"](spark, SF_SMALL).collect()}
    monkeypatch.setattr(data, "PARTITION_ROWS", -(-plain.rows // 37))
    assert 30 <= data.RetailData(spark, SF_SMALL).partitions <= 37
    df = QUERIES["clip_nonneg"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"hashpartitioning\(item_id#\d+, store_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)
    assert found == [str(data.RetailData(spark, SF_SMALL).partitions)]
    assert {tuple(r) for r in df.collect()} == before


def test_partitions_of_the_line_items_follow_their_number(spark, monkeypatch):
    """The daily aggregate, the series' maps and the weekly prices run in partitions of the line items, not of the session."""
    from panelcast.plans import data, queries  # noqa: F401
    from panelcast.plans.registry import QUERIES
    plain = data.RetailData(spark, SF_SMALL)
    assert plain.line_partitions is None
    assert plain.lines == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    before = sorted(map(str, QUERIES["merge_all"](spark, SF_SMALL).collect()))
    monkeypatch.setattr(data, "PARTITION_LINES", -(-plain.lines // 23))
    df = QUERIES["merge_all"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    n = data.RetailData(spark, SF_SMALL).line_partitions
    assert 20 <= n <= 23
    assert re.search(rf"hashpartitioning\(item_id#\d+, dept_id#\d+, cat_id#\d+, store_id#\d+, state_id#\d+, date#\d+, {n}\), REPARTITION_BY_NUM", plan)
    assert re.search(rf"hashpartitioning\(item_id#\d+, {n}\), REPARTITION_BY_NUM", plan)
    # nothing of the items' rows is dealt by the session's number of partitions
    assert not re.search(r"hashpartitioning\(item_id#[^)]*\), ENSURE_REQUIREMENTS", plan)
    assert sorted(map(str, df.collect())) == before


def test_quantiles_of_paths_come_without_a_row_per_sample(spark):
    from panelcast.models.paths import forecast_paths, sample_paths
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    rows = [("a", d, float(i * i % 11)) for i, d in enumerate(days) if i not in (5, 20)]
    rows += [("b", days[0], 4.0), ("b", days[2], None), ("c", days[3], 1.5)]
    series = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    fc = forecast_paths(series, 9, 7, return_samples=True)
    assert not re.search(r"inline|percentile", fc._jdf.queryExecution().optimizedPlan().toString())
    q = F.percentile("y", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975)))
    want = {(r.unique_id, r.ds): r for r in sample_paths(series, 9, 7).groupBy("unique_id", "ds").agg(
        q.alias("q"), F.min("status").alias("status"), F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "y"))), lambda s: s["y"]).alias("all")).collect()}
    got = fc.collect()
    assert len(got) == len(want) == 27
    for r in got:
        w = want[r.unique_id, r.ds]
        assert r.status == w.status and [r[f"sample_{i}"] for i in range(1, 8)] == w["all"]
        for a, b in zip((r.yhat, r.yhat_lower, r.yhat_upper), w.q or (None,) * 3, strict=True):
            assert a == b or abs(a - b) < 1e-12


def test_additive_forecast_fits_once(spark):
    from panelcast.models import additive
    from panelcast.plans import data, queries
    d = data.RetailData(spark, SF_SMALL)
    fitted = queries._additive(d)
    seen = []
    select = type(fitted).select
    class Watched:
        def __getattr__(self, name):
            return getattr(fitted, name)
        def select(self, *cols):
            seen.append(cols)
            return select(fitted, *cols)
    out = additive.components(Watched(), d.calendar(), 28, keys=queries.SERIES_KEYS, **queries._additive_columns(d))
    assert ("holidays", "regressors") not in seen
    about = select(fitted, "holidays", "regressors").first()
    known = queries._additive_columns(d)
    assert list(about["holidays"]) == known["names"] and list(about["regressors"]) == list(known["regressors"])
    assert "part_sell_price" in out.columns and "part_snap" in out.columns


def test_panel_is_sorted_once_by_week(spark):
    """The window that looks for sales in a price's week and the one that fills the prices share a sort."""
    from panelcast.plans import data
    plan = data.RetailData(spark, SF_SMALL).panel()._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if re.search(r"\bSort \[item_id#\d+ ASC NULLS FIRST, store_id#\d+ ASC NULLS FIRST, wm_yr_wk", line)]
    assert len(sorts) == 1


def test_price_of_a_week_without_sales_is_not_used(spark):
    from panelcast.operators.fills import attach_prices_filled
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    sales = spark.createDataFrame([("a", "s", day(n), n // 7, 1) for n in (7, 8, 21, 22)] + [("a", "s", None, 3, 2), ("b", "s", day(0), None, 3)],
                                  "item_id string, store_id string, date date, wm_yr_wk int, sales int")
    prices = spark.createDataFrame([("a", "s", 0, 1.0), ("a", "s", 2, 2.0), ("a", "s", 3, 3.0), ("a", "s", 3, 3.0), ("b", "s", 5, 9.0)],
                                   "item_id string, store_id string, wm_yr_wk int, sell_price double")
    got = sorted(((r.item_id, str(r.date), r.sell_price) for r in attach_prices_filled(sales, prices).collect()))
    assert got == [("a", "2024-01-08", 3.0), ("a", "2024-01-09", 3.0), ("a", "2024-01-22", 3.0), ("a", "2024-01-23", 3.0), ("a", "None", 3.0),
                   ("b", "2024-01-01", 0.0)]


def test_boosting_keeps_one_copy_of_the_feature_table(spark, monkeypatch):
    """The learner bins the written table; no second copy of it is cached."""
    from pyspark.ml.regression import GBTRegressor

    from panelcast.models.gbt import gbt_fit
    seen, fit = [], GBTRegressor.fit

    def watched(self, df):
        seen.append((df.storageLevel.useDisk or df.storageLevel.useMemory, df._jdf.queryExecution().analyzed().toString()))
        return fit(self, df)

    monkeypatch.setattr(GBTRegressor, "fit", watched)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=k // 10), float(k % 10), float(k % 10 > 4)) for k in range(600)]
    rows += [(dt.date(2024, 1, 5), None, 0.0), (dt.date(2024, 1, 6), float("nan"), None)]
    df = spark.createDataFrame(rows, "date date, x double, sales double")
    model = gbt_fit(df, "sales", features=["x"], max_iter=5, step_size=0.5, missing_cols=["x"])
    (cached, plan), = seen
    assert not cached and "LogicalRDD" in plan
    got = {r.x: r.yhat for r in model.predict(df.where("sales IS NOT NULL AND x IS NOT NULL")).collect()}
    assert all(abs(y - (x > 4)) < 0.2 for x, y in got.items())


def test_unread_prices_are_not_derived(spark):
    from panelcast.operators.fills import attach_prices_filled
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    sales = spark.createDataFrame([("a", "x", day(0), 1, 3), ("a", "x", day(1), 1, 0), ("a", "x", day(14), 3, 2), ("a", "x", day(21), 4, 1),
                                   ("b", "x", day(0), 1, 1)], "item_id string, store_id string, date date, wm_yr_wk int, sales int")
    # weeks 0 and 2 have no sales row: their prices count nowhere; week 4 has a row and no price
    prices = spark.createDataFrame([("a", "x", 0, 9.0), ("a", "x", 2, 7.0), ("a", "x", 3, 5.0)],
                                   "item_id string, store_id string, wm_yr_wk int, sell_price double")
    panel = attach_prices_filled(sales, prices, partitions=3)
    got = {(r.item_id, r.date): r.sell_price for r in panel.collect()}
    assert got == {("a", day(0)): 5.0, ("a", day(1)): 5.0, ("a", day(14)): 5.0, ("a", day(21)): 5.0, ("b", day(0)): 0.0}
    plan = panel.where(F.col("date") < F.lit(day(15))).select("item_id", "store_id", "date", "sales")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "Union" not in text and plan.count() == 4


def test_arima_sorts_no_days(spark):
    from panelcast.models import arima
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=n), float(n * n % 11)) for n in range(60)]
    model = arima.fit(spark.createDataFrame(rows, "unique_id string, ds date, y double"), arima.SEARCH)
    text = model._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "Join" not in text
    assert text.count("Aggregate [unique_id") == 2   # filters on the model stop at the upper one
    gap = spark.createDataFrame(rows[:20] + rows[21:], "unique_id string, ds date, y double")
    with pytest.raises(Exception, match="daily grid"):
        arima.fit(gap).collect()


def test_lag_gram_sums_every_product(spark):
    import numpy as np

    from panelcast.functions.linalg import lag_gram
    rng = np.random.default_rng(1)
    columns, since = [(None, 0), *[("y", k) for k in range(5)], ("e", 1), ("e", 3)], 6
    series = {n: (rng.integers(0, 9, n).astype(float).tolist(), rng.normal(size=n).tolist()) for n in (3, 7, 12, 13, 40)}
    holes = [None if k % 5 == 2 else v for k, v in enumerate(series[40][0])]
    rows = [(f"{n}", y, e) for n, (y, e) in series.items()] + [("holes", holes, series[40][1])]
    df = spark.createDataFrame(rows, "k string, y array<double>, e array<double>")
    full = lambda t: (t >= since) & F.get("y", t - 4).isNotNull()
    got = {r.k: r.g for r in df.select("k", lag_gram(columns, since, F.size("y"), ~F.exists("y", lambda v: v.isNull()), full).alias("g")).collect()}
    for k, y, e in rows:
        z = [[1.0 if a is None else {"y": y, "e": e}[a][t - lag] for a, lag in columns] for t in range(since, len(y)) if y[t - 4] is not None]
        z = np.array([[np.nan if v is None else v for v in r] for r in z], dtype=float).reshape(-1, len(columns))
        want = np.nansum(z[:, :, None] * z[:, None, :], axis=0)
        assert np.allclose(np.array(got[k], dtype=float), want, rtol=1e-12, atol=1e-9), k


@pytest.mark.parametrize("fill", [True, False])
def test_calendar_columns_attached_after_the_price_step_are_the_same(spark, fill):
    """Labels with several calendar rows, without one, and null ones; prices that come twice."""
    from panelcast.plans.preprocess import merge_all
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    sales = spark.createDataFrame([("a", "x", f"d_{n}", n) for n in (1, 2, 3, 8, 9, 15, 40)] + [("a", "x", None, 5), ("b", "x", "d_2", None), ("b", None, "d_3", 2)],
                                  "item_id string, store_id string, d string, sales int")
    calendar = spark.createDataFrame(
        [(f"d_{n}", day(n), n // 7, f"w{n % 7}", "feast" if n == 8 else None) for n in range(1, 20)]
        + [("d_2", day(2), 0, "again", None), ("d_2", day(2), 0, "again", None), ("d_3", day(5), 1, "later", None), ("d_9", None, None, None, None), (None, day(1), 0, "none", None)],
        "d string, date date, wm_yr_wk int, weekday string, event_name_1 string")
    prices = spark.createDataFrame([("x", "a", 0, 1.5), ("x", "a", 2, 2.5), ("x", "a", 2, 2.5), ("x", "b", 1, 9.0)], "store_id string, item_id string, wm_yr_wk int, sell_price double")
    one, two = (merge_all(sales, calendar, prices, fill=fill, late=late) for late in (False, True))
    assert one.columns == two.columns and one.dtypes == two.dtypes
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_panel_is_shuffled_without_the_calendar_columns(spark):
    """Of the calendar, only date and week are sent with the panel's rows where a query reads every column of it."""
    from panelcast.plans import queries  # noqa: F401
    from panelcast.plans.registry import QUERIES
    for name, exchange in (("merge_all", r"Exchange hashpartitioning\(item_id#\d+, store_id#\d+, \d+\), REPARTITION_BY_COL"), ("null_audit", "Exchange hashpartitioning")):
        lines = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = [re.search(r"[A-Za-z*]", line).start() if re.search(r"[A-Za-z*]", line) else 0 for line in lines]
        below = [lines[j] for i, line in enumerate(lines) if re.search(exchange, line)
                 for j in range(i + 1, next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines)))]
        assert below and any("wm_yr_wk" in line for line in below) and not any("weekday" in line for line in below), name
