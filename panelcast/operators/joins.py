"""Joins of the sales panel with its dimensions, and forecast alignment joins.

Broadcast policy: only sides whose size is fixed by definition get a hint (the calendar, the
top-n list with a small n); every other join is left to the planner: sort merge, or a
broadcast that the optimizer chooses from a size, at runtime from the measured one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SERIES = ("item_id", "store_id")
PRICE_KEYS = ("store_id", "item_id", "wm_yr_wk")
MAX_HINT_ROWS = 10_000

def join_calendar(sales: DataFrame, cal: DataFrame, cal_cols: Sequence[str] | None = None,
                  hint: bool = True) -> DataFrame:
    """sales ⟕ calendar on ``d``. A calendar has one row per day (a century is 36,525 rows), so
    by default it gets the broadcast hint; ``hint=False`` for a frame that isn't one."""
    if cal_cols is not None:
        cal = cal.select("d", *[c for c in cal_cols if c != "d"])
    return sales.join(F.broadcast(cal) if hint else cal, "d", "left")


def attach_date(sales: DataFrame, cal: DataFrame) -> DataFrame:
    """Attach only ``date`` to ``d`` (2-column projection of the calendar)."""
    return join_calendar(sales, cal, ["date"])


def join_prices(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """sales ⟕ prices on (store_id, item_id, wm_yr_wk); keys cast to common types."""
    p = prices.select(F.col("store_id").cast("string"), F.col("item_id").cast("string"),
                      F.col("wm_yr_wk").cast("int"), F.col("sell_price").cast("double"))
    return sales.join(p, list(PRICE_KEYS), "left")


def item_totals(sales: DataFrame, item: str = "item_id", target: str = "sales") -> DataFrame:
    return sales.groupBy(item).agg(F.sum(target).cast("bigint").alias("total_sales"))


def top_items(sales: DataFrame, n: int = 50, item: str = "item_id",
              target: str = "sales") -> DataFrame:
    """The ``n`` items with the largest volume; ties keep the smaller item id.

    Partial sums per item are combined after the shuffle; the final ordering
    is a TakeOrderedAndProject over one row per item.
    """
    return (item_totals(sales, item, target)
            .orderBy(F.desc("total_sales"), F.asc(item)).limit(n))


def keep_top_items(sales: DataFrame, n: int = 50, item: str = "item_id",
                   target: str = "sales", source: DataFrame | None = None) -> DataFrame:
    """Semi join with the top-``n`` item list (``n`` rows: a hint up to ``MAX_HINT_ROWS``)."""
    top = top_items(source if source is not None else sales, n, item, target).select(item)
    return sales.join(F.broadcast(top) if n <= MAX_HINT_ROWS else top, item, "left_semi")


def join_actual_pred(actual: DataFrame, pred: DataFrame,
                     keys: Sequence[str] = ("unique_id", "ds")) -> DataFrame:
    """Inner key join of actuals with forecasts (never by position)."""
    return actual.join(pred, list(keys), "inner")


def regressor_means(train: DataFrame, regressors: Sequence[str],
                    series: Sequence[str] = ("unique_id",)) -> DataFrame:
    """Training mean of each regressor per series."""
    return train.groupBy(*series).agg(*[F.avg(r).alias(r) for r in regressors])


def future_regressors(future: DataFrame, known: DataFrame | None, train: DataFrame,
                      regressors: Sequence[str], series: Sequence[str] = ("unique_id",),
                      date: str = "ds") -> DataFrame:
    """Regressor values for future dates, joined on (series, date).

    A value missing in ``known`` falls back to the series' training mean.
    """
    means = regressor_means(train, regressors, series).select(
        *series, *[F.col(r).alias(f"{r}__mean") for r in regressors])
    out = future
    if known is not None:
        out = out.join(known.select(*series, date, *regressors), [*series, date], "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(r) for r in regressors])
    out = out.join(means, list(series), "left")
    return out.select(*[c for c in out.columns if c not in regressors and not c.endswith("__mean")],
                      *[F.coalesce(F.col(r).cast("double"), F.col(f"{r}__mean")).alias(r)
                        for r in regressors])


def future_from_panel(panel: DataFrame, cutoff, known: dict[str, Column], keys: Sequence[str] = SERIES,
                      date: str = "date") -> DataFrame:
    """(unique_id, ds, regressors) for the panel's rows from ``cutoff`` on: the known value,
    else the mean of the series' own rows before it. One window on the panel's key, no join."""
    whole = Window.partitionBy(*keys)
    past = F.col(date) < F.lit(cutoff)
    cols = [F.coalesce(value.cast("double"), F.avg(F.when(past, F.col(name).cast("double"))).over(whole)).alias(name)
            for name, value in known.items()]
    out = panel.select(F.concat_ws("_", *keys).alias("unique_id"), F.col(date).alias("ds"), *cols)
    return out.where(F.col("ds") >= F.lit(cutoff))
