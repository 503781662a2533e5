"""Spark queries vs the DuckDB oracle on the smallest tables (the gate, in small)."""

import datetime as dt
import math

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ["region", "nation", "supplier", "part", "lineitem", "events"]
FAST = ["merge_all", "build_features", "evaluate_all", "flagship_store_scores", "leaderboard",
        "model_vs_benchmark", "top_items", "null_audit", "correlation_matrix",
        "seasonal_decompose", "densify_zero", "densify_ffill", "path_quantiles",
        "residual_histogram", "m_wrmsse", "scan_calendar", "metrics_json", "direct_training_rows",
        "scan_sales", "pacf", "fc_paths_samples", "fc_seasonal_ar", "future_regressors", "run_models",
        "load_all", "preprocess_test", "forecast_scaled", "filter_options"]


def _norm(v):
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, dt.datetime) and v.time() == dt.time(0):
        v = v.date()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, sorted((tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    got = _rows(E.queries()[name](spark, SF_SMALL).toPandas())
    want = _rows(con.execute(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "RMSE" in df.columns
