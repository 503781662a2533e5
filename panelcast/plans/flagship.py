"""Flagship query: panel -> split -> 28-day-lag forecast -> per-store scores -> ranking.

Touches the source views, the calendar and price joins, the per-series fills
and windows, the actual/forecast key join, grouped metrics and a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.operators import metrics
from panelcast.operators.fills import lag_from
from panelcast.plans.data import RetailData
from panelcast.plans.registry import register, round_doubles

TEST_DAYS = 28


def forecast_and_scale(panel: DataFrame, cut, lags=(28,), keys=("item_id", "store_id"),
                       keep=(), date: str = "date", target: str = "sales",
                       weight_days: int | None = None, price: str = "sell_price"):
    """Seasonal-naive forecasts for the test window *and* the per-series RMSSE
    scale of the training part, from ONE window pass over the panel.

    Both outputs derive from the same windowed frame, so the panel's shuffle
    (and its Exchange) is shared instead of being planned twice.
    Returns (forecasts long by ``model`` = lag_<L>, scale); with
    ``weight_days`` the scale frame also carries ``weight``, the series'
    dollar sales over the last ``weight_days`` training days (same pass).
    """
    w = Window.partitionBy(*keys).orderBy("ds")
    # the typed projection comes first, so both branches see the same input
    # below the window's exchange and the planner can reuse it
    extra = [F.col(price).cast("double").alias("_price")] if weight_days else []
    src = panel.select(*keys, *keep, F.col(date).alias("ds"), F.col(target).cast("double").alias("y"),
                       *extra)
    y = F.col("y")
    base = src.select(*keys, *keep, "ds", "y", *(["_price"] if weight_days else []),
                      (y - F.lag(y, 1).over(w)).alias("_diff"),
                      *[lag_from(y, L, F.date_sub(F.lit(cut), 1), TEST_DAYS, keys).alias(f"lag_{L}") for L in lags])
    base = base.withColumn("unique_id", F.concat_ws("_", *keys))
    test = base.where(F.col("ds") >= F.lit(cut))
    pred = test.unpivot(["unique_id", *keys, *keep, "ds", "y"], [f"lag_{L}" for L in lags],
                        "model", "yhat")
    aggs = [F.coalesce(F.avg(F.pow("_diff", 2)), F.lit(1.0)).alias("scale")]
    if weight_days:
        recent = F.col("ds") >= F.date_sub(F.lit(cut), weight_days)
        aggs.append(F.sum(F.when(recent, F.col("y") * F.col("_price"))).alias("weight"))
    scale = base.where(F.col("ds") < F.lit(cut)).groupBy("unique_id").agg(*aggs)
    return pred, scale


def flagship(spark: SparkSession, sf_dir: str, lag: int = 28) -> DataFrame:
    d = RetailData(spark, sf_dir)
    pred, scale = forecast_and_scale(d.panel(), d.cutoff(TEST_DAYS), (lag,))
    scores = metrics.evaluate_all(pred, ["store_id"], scale)
    return round_doubles(metrics.leaderboard(scores, model="store_id"))


@register("flagship_store_scores")
def q_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)
