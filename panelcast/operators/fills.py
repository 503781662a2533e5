"""Gap filling and daily grids, per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SERIES = ("item_id", "store_id")
EVENT_COLS = ("event_name_1", "event_type_1", "event_name_2", "event_type_2")
NO_EVENT = "NoEvent"


def fill_prices(df: DataFrame, keys: Sequence[str] = SERIES, date: str = "date",
                col: str = "sell_price") -> DataFrame:
    """Forward fill, then backward fill, then 0.0, within each series.

    The backward fill only matters where the forward fill is still NULL, i.e.
    before the series' first price, and there it equals the first non-null
    price of the whole series: a whole-partition aggregate computed once per
    series. (A current-row..unbounded-following frame would be re-aggregated
    for every row, quadratic in the series length.)
    """
    w = Window.partitionBy(*keys).orderBy(date)
    fwd = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first_in_series = F.first(col, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(col, F.coalesce(fwd, first_in_series, F.lit(0.0)))


def fill_missing(df: DataFrame, keys: Sequence[str] = SERIES, date: str = "date",
                 prices_filled: bool = False) -> DataFrame:
    """Prices filled per series; event columns -> 'NoEvent'; sales -> 0."""
    if "sell_price" in df.columns and not prices_filled:
        df = fill_prices(df, keys, date)
    fills = {c: NO_EVENT for c in EVENT_COLS if c in df.columns}
    if "sales" in df.columns:
        fills["sales"] = 0
    return df.fillna(fills) if fills else df


def null_audit(df: DataFrame, stage: str | None = None) -> DataFrame:
    """Null count per column, as (column, nulls) rows, from one aggregate pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    out = counts.unpivot([], df.columns, "column", "nulls")
    if stage is not None:
        out = out.select(F.lit(stage).alias("stage"), "column", "nulls")
    return out


def _grid(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    bounds = df.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(date))


def densify_zero(df: DataFrame, keys: Sequence[str] = ("unique_id",), date: str = "ds",
                 value: str = "y") -> DataFrame:
    """Daily grid from each series' first to last date; missing values -> 0."""
    grid = _grid(df, keys, date)
    return (grid.join(df.select(*keys, date, value), [*keys, date], "left")
            .select(*keys, date, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value)))


def densify_ffill(df: DataFrame, keys: Sequence[str] = (), date: str = "date",
                  value: str = "sales") -> DataFrame:
    """Daily grid with the last seen value carried forward.

    With no keys the input must be a small aggregate (e.g. daily totals).
    """
    if keys:
        grid = _grid(df, keys, date)
        w = Window.partitionBy(*keys).orderBy(date)
    else:
        b = df.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
        grid = b.select(F.explode(F.sequence("_lo", "_hi")).alias(date))
        w = Window.orderBy(date)
    joined = grid.join(df.select(*keys, date, value), [*keys, date], "left")
    return joined.select(*keys, date, F.last(value, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias(value))


def attach_prices_filled(sales: DataFrame, prices: DataFrame, keys: Sequence[str] = SERIES,
                         date: str = "date", week: str = "wm_yr_wk",
                         price: str = "sell_price", partitions: int | None = None) -> DataFrame:
    """sales ⟕ prices on (keys, week) *and* the per-series price fill, in one pass.

    Price rows are unioned with the sales rows and both are partitioned by the
    series key only; within a series (ordered by week, price row first, then
    date) ``last(price, ignorenulls)`` is the forward fill (it returns the
    row's own week price when there is one) and ``first(price, ignorenulls)``
    over the following rows is the backward fill. Price rows of weeks in which
    the series has no sales row lose their price first (a window on (keys, week), which
    the partitioning by keys already satisfies), so only the prices a left
    join would attach are used, as in join-then-fill. No row is dropped by what the
    windows find: where a query reads no price, the planner leaves them and the price rows out.

    Compared with a join on (store, item, week) followed by a window on
    (item, store), the panel is shuffled once instead of twice, and the later
    feature windows (same partitioning) reuse that shuffle. ``partitions`` is its
    number of partitions: the panel's rows compress so well that partitions of the
    planner's size in bytes hold many millions of them, which the sorts then unpack.
    """
    p = prices.select(*[F.col(k).cast("string").alias(k) for k in keys],
                      F.col(week).cast("int").alias(week), F.col(price).cast("double").alias(price))
    s = sales.withColumn(price, F.lit(None).cast("double")).withColumn("_price_row", F.lit(False))
    u = s.unionByName(p.withColumn("_price_row", F.lit(True)), allowMissingColumns=True)
    # one exchange on the series key serves this window and all later ones
    u = u.repartition(partitions, *keys) if partitions else u.repartition(*keys)
    # ordered like the next window although the maximum needs no order: one sort then serves both
    in_week = Window.partitionBy(*keys, week).orderBy(F.desc("_price_row"), F.col(date)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    u = u.withColumn("_sold", F.max(~F.col("_price_row")).over(in_week))
    u = u.withColumn(price, F.when(F.col("_sold"), F.col(price)))
    w = Window.partitionBy(*keys).orderBy(F.col(week), F.desc("_price_row"), F.col(date))
    fwd = F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # backward fill = the series' first price (see fill_prices): O(n), not O(n^2)
    bwd = F.first(price, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = u.withColumn(price, F.coalesce(fwd, bwd, F.lit(0.0))).where(~F.col("_price_row"))
    return out.drop("_price_row", "_sold")


def day_index(date: str = "ds") -> Column:
    """Days since the epoch: the order of frames that count days, not rows."""
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))


def lag_days(y: Column, days: int, keys: Sequence[str], date: str = "ds") -> Column:
    """The value exactly ``days`` days earlier; 0 for a missing day of the series, NULL
    before its first day. A range frame: no densified copy of the series is needed."""
    w = Window.partitionBy(*keys).orderBy(day_index(date))
    first = F.min(date).over(Window.partitionBy(*keys))
    there = F.max(y).over(w.rangeBetween(-days, -days))
    return F.when(F.date_sub(F.col(date), days) >= first, F.coalesce(there, F.lit(0.0)))


def lag_from(y: Column, lag: int, origin: Column, horizon: int, keys: Sequence[str], date: str = "ds") -> Column:
    """Seasonal-naive value of the ``horizon`` days after ``origin``, the last known day: step h repeats the day
    ``lag * ceil(h / lag)`` before it, which is never after the origin. NULL on all other days."""
    turn = F.ceil(F.datediff(F.col(date), origin) / lag)
    cases = None
    for k in range(1, -(-horizon // lag) + 1):
        value = lag_days(y, lag * k, keys, date)
        cases = F.when(turn == k, value) if cases is None else cases.when(turn == k, value)
    return cases


def require_daily(df: DataFrame, keys: Sequence[str] = ("unique_id",), date: str = "ds") -> DataFrame:
    """``df`` itself; an error when it runs if a series has missing or repeated days.
    For operators whose row offsets stand for days."""
    whole = Window.partitionBy(*keys)
    days = F.datediff(F.max(date).over(whole), F.min(date).over(whole)) + 1
    checked = F.when(F.count("*").over(whole) == days, F.col(date)).otherwise(
        F.raise_error(F.lit("series are not on a daily grid: densify them first")).cast("date"))
    return df.withColumn(date, checked)


def daily_arrays(df: DataFrame, keys: Sequence[str] = ("unique_id",), date: str = "ds", value: str = "y",
                 facts: Sequence[Column] = ()) -> DataFrame:
    """(keys, last, values, facts): one row per series, its values as an array in the order of days, checked like
    ``require_daily`` by the same aggregate. Array offsets stand for days; ``facts`` are more aggregates of the series."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(date).alias("_lo"), F.max(date).alias("last"),
                                 F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v"))).alias("_rows"), *facts)
    checked = F.when(F.col("_n") == F.datediff("last", "_lo") + 1, F.array_sort("_rows")).otherwise(
        F.raise_error(F.lit("series are not on a daily grid: densify them first")).cast(rows.schema["_rows"].dataType))
    out = rows.withColumn("values", F.transform(checked, lambda r: r["v"]))
    return out.drop("_n", "_lo", "_rows")
