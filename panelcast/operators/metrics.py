"""Accuracy metrics, leaderboards and forecast post-processing.

All metrics are computed in two aggregate levels so that grouping keys may be
empty (overall), a hierarchy level, a model, or the series itself:

1. per (keys, series): error sums and counts, and the series' RMSSE,
2. per keys: pooled RMSE/MAE/MAPE/sMAPE and the weighted mean of RMSSE.

No join is needed except the per-series RMSSE scale (one row per series).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("RMSE", "MAE", "MAPE", "sMAPE", "WRMSSE")
SCALE_FLOOR = 1e-8


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rmse_expr(y: str = "y", yhat: str = "yhat") -> Column:
    return F.sqrt(F.avg(F.pow(_c(y) - _c(yhat), 2)))


def mae_expr(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg(F.abs(_c(y) - _c(yhat)))


def mape_expr(y: str = "y", yhat: str = "yhat") -> Column:
    """Percent; rows with y = 0 are left out; NULL when none is left."""
    return F.avg(F.when(_c(y) != 0, F.abs((_c(y) - _c(yhat)) / _c(y)))) * 100


def smape_expr(y: str = "y", yhat: str = "yhat") -> Column:
    """0-200 percent; rows with a zero denominator are left out; 0.0 when none is left."""
    den = (F.abs(_c(y)) + F.abs(_c(yhat))) / 2
    return F.coalesce(F.avg(F.when(den != 0, F.abs(_c(y) - _c(yhat)) / den)) * 100, F.lit(0.0))


def require_rows(df: DataFrame) -> DataFrame:
    """``df`` itself; scoring nothing is an error, not a score."""
    if df.isEmpty():
        raise ValueError("nothing to score: no actual has a forecast")
    return df


def series_scale(history: DataFrame, series: Sequence[str] = ("unique_id",), date: str = "ds",
                 y: str = "y") -> DataFrame:
    """Mean squared one-step difference per series (1.0 when there is no difference)."""
    w = Window.partitionBy(*series).orderBy(date)
    diff = F.col(y).cast("double") - F.lag(F.col(y).cast("double"), 1).over(w)
    return (history.select(*series, diff.alias("_d")).groupBy(*series)
            .agg(F.coalesce(F.avg(F.pow("_d", 2)), F.lit(1.0)).alias("scale")))


def per_series_errors(pred: DataFrame, keys: Sequence[str] = (),
                      series: Sequence[str] = ("unique_id",), y: str = "y",
                      yhat: str = "yhat", weight: str | None = None) -> DataFrame:
    yv, pv = F.col(y).cast("double"), F.col(yhat).cast("double")
    e = pv - yv
    den = (F.abs(yv) + F.abs(pv)) / 2
    w = F.first(weight) if weight else F.lit(1.0)
    return pred.groupBy(*keys, *series).agg(
        F.sum(F.pow(e, 2)).alias("_sse"), F.count(e).alias("_n"), F.sum(F.abs(e)).alias("_ae"),
        F.sum(F.when(yv != 0, F.abs(e / yv))).alias("_ape"),
        F.count(F.when(yv != 0, e)).alias("_n_ape"),
        F.sum(F.when(den != 0, F.abs(e) / den)).alias("_sape"),
        F.count(F.when(den != 0, e)).alias("_n_sape"),
        w.cast("double").alias("_w"))


def evaluate_all(pred: DataFrame, keys: Sequence[str] = (), scale: DataFrame | None = None,
                 series: Sequence[str] = ("unique_id",), y: str = "y", yhat: str = "yhat",
                 date: str = "ds", weight: str | None = None, digits: int | None = 4) -> DataFrame:
    """RMSE, MAE, MAPE, sMAPE, WRMSSE per group of ``keys`` (overall when empty).

    ``scale``: per-series RMSSE scale (``series_scale`` of the training history).
    When omitted the scale comes from the actuals themselves.
    """
    per = per_series_errors(pred, keys, series, y, yhat, weight)
    if scale is None:
        scale = series_scale(pred, series, date, y)
    per = per.join(scale.select(*series, "scale"), list(series), "left")
    sc = F.greatest(F.coalesce(F.col("scale"), F.lit(1.0)), F.lit(SCALE_FLOOR))
    per = per.withColumn("_rmsse", F.sqrt(F.try_divide(F.col("_sse"), F.col("_n")) / sc))
    g = per.groupBy(*keys) if keys else per.groupBy()
    out = g.agg(
        F.sqrt(F.try_divide(F.sum("_sse"), F.sum("_n"))).alias("RMSE"),
        F.try_divide(F.sum("_ae"), F.sum("_n")).alias("MAE"),
        (F.try_divide(F.sum("_ape"), F.sum("_n_ape")) * 100).alias("MAPE"),
        F.coalesce(F.try_divide(F.sum("_sape"), F.sum("_n_sape")) * 100, F.lit(0.0)).alias("sMAPE"),
        F.try_divide(F.sum(F.col("_w") * F.col("_rmsse")),
                     F.sum(F.when(F.col("_rmsse").isNotNull(), F.col("_w")))).alias("WRMSSE"))
    if digits is not None:
        out = out.select(*keys, *[F.round(m, digits).alias(m) for m in METRICS])
    return out


def rmsse_per_series(pred: DataFrame, scale: DataFrame | None = None,
                     series: Sequence[str] = ("unique_id",), y: str = "y", yhat: str = "yhat",
                     date: str = "ds") -> DataFrame:
    """RMSSE of each series (the WRMSSE of a one-series group)."""
    out = evaluate_all(pred, series, scale, series, y, yhat, date, digits=None)
    return out.select(*series, F.col("WRMSSE").alias("RMSSE"))


def card_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Dashboard card variant: MAPE uses denominator 1 where the actual is 0."""
    a, p = F.col(actual), F.col(predicted)
    res = a - p
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(F.round(F.sqrt(F.avg(F.pow(res, 2))), 2).alias("RMSE"),
                 F.round(F.avg(F.abs(res)), 2).alias("MAE"),
                 F.round(F.avg(F.abs(res / F.when(a == 0, F.lit(1.0)).otherwise(a))) * 100, 1)
                 .alias("MAPE"))


def leaderboard(results: DataFrame, sort_by: str = "RMSE", ascending: bool = True,
                model: str = "Model") -> DataFrame:
    """Rows = models; ordered by one metric (ties by model name)."""
    order = F.asc_nulls_last(sort_by) if ascending else F.desc_nulls_last(sort_by)
    return results.orderBy(order, F.asc(model))


def best_per_metric(long: DataFrame, model: str = "Model") -> DataFrame:
    """Lowest value per metric; a tie goes to the first model in name order."""
    w = Window.partitionBy("Metric").orderBy(F.asc_nulls_last("Value"), F.asc(model))
    return (long.where(F.col("Value").isNotNull())
            .withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("Metric", F.col(model).alias("Model"), "Value"))


def radar_scores(long: DataFrame, model: str = "Model", digits: int = 3) -> DataFrame:
    """Inverted min-max score per metric (1 = best); a zero range divides by 1."""
    w = Window.partitionBy("Metric")
    lo, hi = F.min("Value").over(w), F.max("Value").over(w)
    rng = F.when((hi - lo) == 0, F.lit(1.0)).otherwise(hi - lo)
    return long.select(model, "Metric", "Value",
                       F.round(1 - (F.col("Value") - lo) / rng, digits).alias("score"))


def pct_band(df: DataFrame, pct: float, yhat: str = "yhat") -> DataFrame:
    """Fixed-percent interval around the forecast; the lower bound floored at 0."""
    p = F.col(yhat)
    return df.withColumns({
        "yhat_lower": F.greatest(p - p * pct, F.lit(0.0)),
        "yhat_upper": p + p * pct,
    })


# Interval widths of the fixed-percent bands per forecaster
BAND_PCT = {"seasonal_ar": 0.10, "additive": 0.08, "gbt": 0.05, "direct": 0.06, "paths": 0.12}


def forecast_total(pred: DataFrame, date: str = "ds", yhat: str = "yhat") -> DataFrame:
    return pred.groupBy(date).agg(F.sum(yhat).alias("total_yhat"))


def forecast_scaled(pred: DataFrame, n_total: int, series: str = "unique_id",
                    date: str = "ds", yhat: str = "yhat") -> DataFrame:
    """Sum over fitted series scaled to all series: sum * n_total / n_fitted.

    ``n_fitted`` counts series that produced a forecast (failures excluded); it
    is one scalar, computed first.
    """
    fitted = pred.where(F.col(yhat).isNotNull())
    k = fitted.agg(F.count_distinct(series)).first()[0] or 0
    factor = (n_total / k) if k else None
    return fitted.groupBy(date).agg((F.sum(yhat) * F.lit(factor).cast("double"))
                                    .alias("scaled_yhat"))


def residual_histogram(df: DataFrame, col: str = "residual", bins: int = 50) -> DataFrame:
    """Exactly ``bins`` equal-width bins from min to max; the max goes in the last bin.

    The two bounds are scalars computed first; binning is then a plain groupBy.
    """
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n")


def model_vs_benchmark(pred: DataFrame, model: str, benchmark: str, by: str = "cat_id",
                       scale: DataFrame | None = None) -> DataFrame:
    """Metrics of a model beside a benchmark model, overall and per ``by`` group,
    with the percent difference (NULL when the benchmark value is 0)."""
    two = pred.where(F.col("model").isin(model, benchmark))
    per_group = evaluate_all(two, ["model", by], scale)
    overall = evaluate_all(two, ["model"], scale).withColumn(by, F.lit("ALL"))
    both = per_group.unionByName(overall)
    long = both.unpivot(["model", by], list(METRICS), "Metric", "Value")
    piv = long.groupBy(by, "Metric").pivot("model", [model, benchmark]).agg(F.first("Value"))
    return piv.select(by, "Metric", F.col(model).alias("model_value"),
                      F.col(benchmark).alias("benchmark_value"),
                      F.round(F.try_divide(F.col(model) - F.col(benchmark), F.col(benchmark)) * 100, 4)
                      .alias("pct_diff"))


def alignment_report(actual: DataFrame, pred: DataFrame,
                     keys: Sequence[str] = ("unique_id", "ds")) -> DataFrame:
    """How actuals and forecasts line up by key: matched, actual-only and
    forecast-only row counts (one full outer join, one aggregate)."""
    a = actual.select(*keys, F.lit(True).alias("_a")).distinct()
    p = pred.select(*keys, F.lit(True).alias("_p")).distinct()
    j = a.join(p, list(keys), "full")
    return j.agg(F.count_if(F.col("_a") & F.col("_p")).alias("matched"),
                 F.count_if(F.col("_a") & F.col("_p").isNull()).alias("actual_only"),
                 F.count_if(F.col("_a").isNull() & F.col("_p")).alias("forecast_only"))
