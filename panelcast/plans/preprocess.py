"""Preprocessing plan: melt -> top-N -> calendar/price joins -> fills -> split.

The top-N semi join is applied *before* the joins (the reference filters at
the end); all joins are left joins on unique dimension keys and the fills act
within one series, so the result is the same while the joins see less data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.fills import attach_prices_filled, fill_missing
from panelcast.operators.joins import join_calendar, join_prices, keep_top_items
from panelcast.operators.reshape import day_columns, melt_sales, train_test_split

SERIES = ("item_id", "store_id")
CALENDAR_KEYS = ("d", "date", "wm_yr_wk")


def merge_all(sales_long: DataFrame, calendar: DataFrame, prices: DataFrame,
              keys: Sequence[str] = SERIES, fill: bool = True, partitions: int | None = None, late: bool = False) -> DataFrame:
    """sales ⟕ calendar (one row per day) ⟕ prices, then per-series fills.

    With ``fill`` the price join and the price fill run as one windowed pass
    partitioned by the series key (``attach_prices_filled``), which the feature
    windows downstream reuse.

    ``late``: only the calendar's date and week go through the price step's shuffle and sorts, its other columns are attached
    after it. For callers that read most of them: a second broadcast join, which runs even if none is read.
    """
    def priced(dated: DataFrame) -> DataFrame:
        return attach_prices_filled(dated, prices, keys, partitions=partitions) if fill else join_prices(dated, prices)

    if late:
        # a label may have several calendar rows: each date and week of it once here, each of its rows once below
        near = [c for c in CALENDAR_KEYS if c in calendar.columns]
        out = priced(join_calendar(sales_long, calendar.select(*near).distinct()))
        far = calendar.select(*[F.col(c).alias(f"_{c}") if c in near else F.col(c) for c in calendar.columns])
        same = [out["d"] == F.col("_d"), *[out[c].eqNullSafe(F.col(f"_{c}")) for c in near if c != "d"]]
        order = priced(join_calendar(sales_long, calendar)).columns
        merged = out.join(F.broadcast(far), same, "left").select(*order)
    else:
        merged = priced(join_calendar(sales_long, calendar))
    return fill_missing(merged, keys, prices_filled=True) if fill else merged


def preprocess(sales: DataFrame, calendar: DataFrame, prices: DataFrame, top_n: int | None = 50,
               test_days: int = 28, wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """Full preprocessing; returns lazy (train, test) frames.

    The split date is the last day with a sales row (the calendar may run
    on): for wide input the last day column, known from the schema; for long
    input one aggregate over the ``d`` column alone.
    """
    long = melt_sales(sales) if wide else sales
    day = F.expr("cast(substring(d, 3) as int)")
    if wide:
        last_d = max(int(c[2:]) for c in day_columns(sales))
    else:
        last_d = long.agg(F.max(day)).first()[0]
    if top_n is not None:
        long = keep_top_items(long, top_n)
    panel = merge_all(long, calendar, prices)
    max_date: dt.date = calendar.where(day == (last_d or 0)).agg(F.max("date")).first()[0]
    return train_test_split(panel, test_days, max_date=max_date)
