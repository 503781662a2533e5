"""Retail-panel views derived from the star-schema test tables.

The forecasting operators expect the retail data model (wide daily sales per
item-store, a calendar keyed by ``d``, weekly prices). These functions derive
that model from ``lineitem ⋈ supplier ⋈ nation ⋈ region`` (and ``part`` for the
prices) with Spark, so every query's work grows with the input tables:

* item  = ``PARTS_PER_ITEM`` neighbouring part keys: items, and so series, grow
  with the data; store = state = the supplier's region,
* retail day n = days since the first ship date // ``SHIP_DAYS``,
  ``d = 'd_' || (n + 1)``,
* sales = whole quantity shipped per (item, store, day).

The panel has the faults of real data: a series runs from its own first to its
own last sale (many end early), days without a sale are zero rows, but weeks
without any sale are left out where the week number is a multiple of
``GAP_WEEKS``; prices exist for weeks in which the item sold in *any* store (so
also for weeks a store has no row for), and not at all in some weeks; the
calendar runs ``CALENDAR_AHEAD`` days past the last sale. ``gaps=False`` gives
the same panel on a gap-free daily grid.

The date range comes from the data (two scalars); the calendar is expanded
inside the plan from that aggregate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.calendar import day_name, retail_wday
from panelcast.sources.tables import read_table

SERIES_KEYS = ("item_id", "store_id")
HIERARCHY = ("item_id", "dept_id", "cat_id", "store_id", "state_id")

# Fixed values of the fixture calendar (must match the oracle SQL):
# fixed-date events (month-day, name, type)
FIXED_EVENTS = [
    ("12-25", "Christmas", "National"),
    ("07-04", "IndependenceDay", "National"),
    ("02-14", "ValentinesDay", "Cultural"),
    ("10-31", "Halloween", "Cultural"),
]
# the first Sunday of February
SUPERBOWL = ("SuperBowl", "Sporting")
# second event slot: month-day, name, type
SECOND_EVENT = ("07-04", "Parade", "Cultural")
# SNAP days per state (region name): first day, last day, even days only
SNAP_RULES = [
    ("AFRICA", 1, 10, False),
    ("AMERICA", 1, 5, False),
    ("ASIA", 6, 15, False),
    ("EUROPE", 2, 12, True),
    ("MIDDLE EAST", 11, 15, False),
]
WEEK_KEY_BASE = 11101
PARTS_PER_ITEM = 25
SHIP_DAYS = 4
GAP_WEEKS = 4
CALENDAR_AHEAD = 28
# no price row in weeks n with n % PRICE_CYCLE == PRICE_GAP
PRICE_CYCLE, PRICE_GAP = 7, 3


def snap_column(state: str) -> str:
    return "snap_" + state.replace(" ", "_")


SNAP_MAP = {state: snap_column(state) for state, *_ in SNAP_RULES}


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: first ship date and the last retail day."""
    day = F.to_date("l_shipdate")
    return (read_table(spark, sf_dir, "lineitem", "l_shipdate")
            .agg(F.min(day).alias("lo"), F.max(day).alias("last"))
            .select("lo", F.date_add("lo", F.floor(F.datediff("last", "lo") / SHIP_DAYS).cast("int")).alias("hi")))


def date_bounds(spark: SparkSession, sf_dir: str) -> tuple[dt.date, dt.date]:
    """First day and the last day with a sale (two scalars; one small aggregate job)."""
    row = _range(spark, sf_dir).first()
    return row["lo"], row["hi"]


def panel_size(spark: SparkSession, sf_dir: str) -> tuple[dt.date, dt.date, int, int]:
    """``date_bounds``, about the most rows the panel can have (every item in every region on every day) and the number of
    line items: four scalars of one aggregate."""
    item = F.floor(F.col("l_partkey") / PARTS_PER_ITEM)
    ends = _range(spark, sf_dir).crossJoin(
        read_table(spark, sf_dir, "lineitem", "l_partkey").agg(
            F.approx_count_distinct(item).alias("items"), F.count("*").alias("lines"))).crossJoin(
        read_table(spark, sf_dir, "region", "r_regionkey").agg(F.count("*").alias("regions")))
    row = ends.first()
    lo, hi = row["lo"], row["hi"]
    return lo, hi, row["items"] * row["regions"] * ((hi - lo).days + 1) if lo else 0, row["lines"]


def day_number(date: Column, day0: dt.date) -> Column:
    return F.datediff(date, F.lit(day0))


def d_label(n: Column) -> Column:
    return F.concat(F.lit("d_"), (n + 1).cast("string"))


def base_lines(spark: SparkSession, sf_dir: str, day0: dt.date) -> DataFrame:
    """Line items with their retail hierarchy: one row per shipped line."""
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    supp = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    # nation and region are fixed-size (25 and 5 rows): safe to broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"))
    region = F.broadcast(read_table(spark, sf_dir, "region", "r_regionkey", "r_name"))
    item_no = F.floor(F.col("l_partkey") / PARTS_PER_ITEM).cast("int")
    n = F.floor(day_number(F.to_date("l_shipdate"), day0) / SHIP_DAYS).cast("int")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .join(supp, li.l_suppkey == supp.s_suppkey)
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.concat(F.lit("ITEM_"), item_no.cast("string")).alias("item_id"),
                    F.concat(F.lit("DEPT_"), (item_no % 6).cast("string")).alias("dept_id"),
                    F.concat(F.lit("CAT_"), (item_no % 3).cast("string")).alias("cat_id"),
                    F.concat(F.col("r_name"), F.lit("_1")).alias("store_id"),
                    F.col("r_name").alias("state_id"),
                    F.date_add(F.lit(day0), n).alias("date"),
                    F.col("l_quantity").alias("quantity"),
                    F.col("p_retailprice").alias("retail_price")))


def daily_lines(spark: SparkSession, sf_dir: str, day0: dt.date, partitions: int | None = None) -> DataFrame:
    """One row per (item, store, day) with a sale: units and the highest list price.

    Sparse sales, the series list and weekly prices all derive from this one
    aggregate, so the line items are scanned and shuffled once per query
    (identical exchanges are reused by the planner).

    ``partitions`` deals the lines, so that no task's aggregate grows with the table: first by item, store and day (the lines
    of a hot item spread over its days), then the daily rows by item, which serves all grouping by item or series and the
    join of the prices. Few lines share an (item, store, day), so summing them before the shuffle would fill a map and save little.
    """
    lines = base_lines(spark, sf_dir, day0)
    if partitions:
        lines = lines.repartition(partitions, *HIERARCHY, "date")
    daily = lines.groupBy(*HIERARCHY, "date").agg(F.sum("quantity").alias("units"), F.max("retail_price").alias("price"))
    return daily.repartition(partitions, "item_id") if partitions else daily


def sales_sparse(spark: SparkSession, sf_dir: str, day0: dt.date | None = None, partitions: int | None = None) -> DataFrame:
    """Units per (item, store, day) for days with a sale."""
    if day0 is None:
        day0 = date_bounds(spark, sf_dir)[0]
    return (daily_lines(spark, sf_dir, day0, partitions)
            .select(*HIERARCHY, d_label(day_number(F.col("date"), day0)).alias("d"),
                    F.col("units").cast("int").alias("sales")))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day, ``CALENDAR_AHEAD`` days past the last sale, with week key,
    events and SNAP flags: expanded in the plan from the ship dates' range."""
    days = _range(spark, sf_dir).select(
        "lo", F.explode(F.sequence("lo", F.date_add("hi", CALENDAR_AHEAD))).alias("date"))
    cal = days.select(F.datediff("date", "lo").alias("n"), "date")
    md = F.date_format("date", "MM-dd")
    first_sunday_feb = ((F.month("date") == 2) & (F.dayofmonth("date") <= 7)
                        & (F.weekday("date") == 6))
    name_expr = F.when(first_sunday_feb, F.lit(SUPERBOWL[0]))
    type_expr = F.when(first_sunday_feb, F.lit(SUPERBOWL[1]))
    for mmdd, name, kind in FIXED_EVENTS:
        name_expr = F.when(md == mmdd, F.lit(name)).otherwise(name_expr)
        type_expr = F.when(md == mmdd, F.lit(kind)).otherwise(type_expr)
    second = md == SECOND_EVENT[0]
    dom = F.dayofmonth("date")
    snaps = []
    for state, first, last, even in SNAP_RULES:
        cond = dom.between(first, last)
        if even:
            cond = cond & (dom % 2 == 0)
        snaps.append(cond.alias(snap_column(state)))
    return cal.select(
        "date",
        (F.lit(WEEK_KEY_BASE) + F.floor(F.col("n") / 7)).cast("int").alias("wm_yr_wk"),
        day_name("date").alias("weekday"),
        retail_wday("date").cast("int").alias("wday"),
        F.month("date").alias("month"),
        F.year("date").alias("year"),
        d_label(F.col("n")).alias("d"),
        name_expr.alias("event_name_1"),
        type_expr.alias("event_type_1"),
        F.when(second, F.lit(SECOND_EVENT[1])).alias("event_name_2"),
        F.when(second, F.lit(SECOND_EVENT[2])).alias("event_type_2"),
        *snaps,
    )


def _week(n: Column) -> Column:
    return F.floor(n / 7).cast("int")


def prices(spark: SparkSession, sf_dir: str, day0: dt.date | None = None, partitions: int | None = None) -> DataFrame:
    """Weekly sell price per (store, item): the highest list price of the item in any
    store that week, for every store that ever sold it; some weeks have none."""
    if day0 is None:
        day0 = date_bounds(spark, sf_dir)[0]
    daily = daily_lines(spark, sf_dir, day0, partitions)
    week = _week(day_number(F.col("date"), day0))
    stores = daily.select("item_id", "store_id").distinct()
    weekly = daily.groupBy("item_id", week.alias("w")).agg(F.max("price").alias("sell_price"))
    return (weekly.where(F.col("w") % PRICE_CYCLE != PRICE_GAP).join(stores, "item_id")
            .select("store_id", "item_id", (F.lit(WEEK_KEY_BASE) + F.col("w")).cast("int").alias("wm_yr_wk"),
                    "sell_price"))


def sales_long(spark: SparkSession, sf_dir: str, day0: dt.date | None = None,
               gaps: bool = True, partitions: int | None = None) -> DataFrame:
    """Long sales: every series from its own first to its own last sale, missing -> 0;
    with ``gaps``, every ``GAP_WEEKS``-th week is left out if the series sold nothing in it.

    Only the sparse facts are shuffled: they are grouped per series into a
    day -> units map (at most one entry per calendar day, a bounded group),
    and each series row then expands to its days with a map lookup. No cross
    join, and no shuffle of the generated grid.
    """
    if day0 is None:
        day0 = date_bounds(spark, sf_dir)[0]
    n = day_number(F.col("date"), day0)
    per_series = (daily_lines(spark, sf_dir, day0, partitions)
                  .groupBy(*HIERARCHY)
                  .agg(F.map_from_entries(F.collect_list(F.struct(
                           n.alias("n"), F.col("units").cast("int").alias("u")))).alias("_m"),
                       F.collect_set(_week(n)).alias("_weeks"),
                       F.min(n).alias("_first"), F.max(n).alias("_last")))
    grid = per_series.select(*HIERARCHY, "_m", "_weeks",
                             F.explode(F.sequence("_first", "_last")).alias("n"))
    if gaps:
        week = _week(F.col("n"))
        grid = grid.where((week % GAP_WEEKS != 0) | F.array_contains("_weeks", week))
    return grid.select(*HIERARCHY, d_label(F.col("n")).alias("d"),
                       F.coalesce(F.try_element_at("_m", F.col("n")), F.lit(0)).alias("sales"))


def sales_wide(spark: SparkSession, sf_dir: str,
               bounds: tuple[dt.date, dt.date] | None = None, partitions: int | None = None) -> DataFrame:
    """Wide daily matrix (one row per item-store, one ``d_N`` column per day)."""
    lo, hi = bounds or date_bounds(spark, sf_dir)
    labels = [f"d_{i}" for i in range(1, (hi - lo).days + 2)]
    sparse = sales_sparse(spark, sf_dir, lo, partitions)
    wide = sparse.groupBy(*HIERARCHY).pivot("d", labels).agg(F.first("sales"))
    # one selectExpr call for the day columns (not one JVM call per column)
    return wide.selectExpr("concat_ws('_', item_id, store_id) AS id", *HIERARCHY,
                           *[f"coalesce(`{c}`, 0) AS `{c}`" for c in labels])
