"""Plan-shape properties that matter at scale (checked on the physical plan)."""

import re

from conftest import SF_SMALL

PANEL_EXCHANGE = re.compile(r"Exchange hashpartitioning\(item_id#\d+, store_id#\d+, \d+\)")
# of the panel's rows; the list of series that the weekly prices need has its own small one
PANEL_ROWS = re.compile(PANEL_EXCHANGE.pattern + ", REPARTITION_BY_COL")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_shuffle_the_panel_once(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["build_features"](spark, SF_SMALL))
    assert len(PANEL_ROWS.findall(plan)) == 1 and len(PANEL_EXCHANGE.findall(plan)) <= 2
    # the calendar join is a broadcast, not a shuffle
    assert re.search(r"BroadcastHashJoin \[d#\d+\], \[d#\d+\], LeftOuter", plan)


def test_flagship_reuses_the_panel_shuffle(spark):
    import __spark_entry__ as E
    df = E.queries()["flagship_store_scores"](spark, SF_SMALL)
    df.collect()
    plan = _plan(df)
    final = plan.split("== Initial Plan ==")[0]
    assert "== Final Plan ==" in final and "ReusedExchange" in final
    # executed panel shuffles: exchanges on the panel key that are not reuses
    executed = [ln for ln in final.splitlines()
                if PANEL_EXCHANGE.search(ln) and "ReusedExchange" not in ln]
    assert len(executed) == 1


def test_scan_prunes_columns(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["daily_totals"](spark, SF_SMALL))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem", plan)
    assert scans and all("l_comment" not in s and "l_tax" not in s for s in scans)


def test_one_panel_shuffle_where_joins_were(spark):
    import __spark_entry__ as E
    for name in ("future_regressors", "clip_nonneg", "fc_paths_samples"):
        assert len(PANEL_ROWS.findall(_plan(E.queries()[name](spark, SF_SMALL)))) == 1, name


def test_run_of_all_models_forecasts_without_the_test_window(spark, monkeypatch):
    """All forecasters take part, and the recursive model makes its own 28 steps."""
    import __spark_entry__ as E
    from panelcast.models import runner
    from panelcast.models.gbt import gbt_fit
    from panelcast.plans import queries
    from pyspark.sql import functions as F

    def refused(d):
        raise AssertionError("features of the test window hold its sales")
    run = {}
    monkeypatch.setattr(queries, "_test_features", refused)
    monkeypatch.setattr(queries, "_gbt", lambda d: gbt_fit(
        queries._features(d).where(F.col("date") < F.lit(d.cutoff(28))), "sales", max_iter=2))
    monkeypatch.setattr(runner, "run_models", lambda train, actual, models, h: run.update(models, train=train)
                        or runner.RunResult(train.limit(0).selectExpr(
                            "unique_id AS Model", "0 AS n_series", "0 AS n_scored", "0 AS n_failed", "true AS complete", "true AS failed",
                            "1 AS rank", "0.0D AS RMSE"), actual, {}))
    E.queries()["run_models_all"](spark, SF_SMALL)
    train = run.pop("train")
    assert set(run) == {"naive_7", "naive_28", "paths", "seasonal_ar", "arima", "additive", "gbt", "direct"}
    series = train.select("unique_id").distinct().count()
    rows = run["gbt"](train, 28).groupBy("unique_id").agg(F.count("*").alias("n"), F.min("yhat").alias("least")).collect()
    assert len(rows) == series and all(r.n == 28 and r.least >= 0 for r in rows)
    assert run["seasonal_ar"](train, 28).select("unique_id", "ds", "yhat").count() % 28 == 0
