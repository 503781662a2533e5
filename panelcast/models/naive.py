"""Seasonal-naive forecasts by date, so gaps in a series don't shift them (a missing day counts as 0).

All forecasts are made on the last day before the cutoff: step h repeats the day lag * ceil(h / lag) before it, so no
value of the forecast window is ever read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.fills import lag_days, lag_from


def lag_forecast(series: DataFrame, cutoff: dt.date, lag: int = 28,
                 keys: Sequence[str] = ("unique_id",), date: str = "ds", y: str = "y",
                 keep: Sequence[str] = (), horizon: int = 28) -> DataFrame:
    """(keys, ds, y, yhat) for ds >= cutoff; yhat is NULL beyond ``horizon`` days."""
    yy = F.col(y).cast("double")
    origin = F.date_sub(F.lit(cutoff), 1)
    return (series.select(*keys, *keep, date, yy.alias("y"), lag_from(yy, lag, origin, horizon, keys, date).alias("yhat"))
            .where(F.col(date) >= F.lit(cutoff)))


def lagged_paths(series: DataFrame, cutoff: dt.date, num_samples: int = 20, step: int = 7,
                 keys: Sequence[str] = ("unique_id",), date: str = "ds",
                 y: str = "y", horizon: int = 28) -> DataFrame:
    """Sample paths: sample k (1..num_samples) repeats the k-th last known season of ``step`` days."""
    yy = F.col(y).cast("double")
    turns = -(-horizon // step)
    lagged = series.select(*keys, date, F.array(*[lag_days(yy, step * k, keys, date) for k in range(1, num_samples + turns)]).alias("_l"))
    lagged = lagged.where(F.col(date) >= F.lit(cutoff))
    turn = F.ceil((F.datediff(F.col(date), F.lit(cutoff)) + 1) / step).cast("int")
    samples = F.transform(F.slice("_l", turn, F.lit(num_samples)), lambda v, i: F.struct((i + 1).alias("sample_id"), v.alias("y")))
    return lagged.select(*keys, date, F.inline(F.when(turn <= turns, samples)))
