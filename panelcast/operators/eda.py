"""Exploration queries: totals, seasonality, correlation, decomposition, ACF/PACF.

Queries that need an ordered pass over *all* rows (decomposition, global
forward fill) always run on an aggregate first (one row per day and series
key), never on the raw panel.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelcast.functions.calendar import day_of_week
from panelcast.functions.linalg import dot, doubles, indices, let


def totals_by(df: DataFrame, key: str, target: str = "sales", name: str = "sales") -> DataFrame:
    return df.groupBy(key).agg(F.sum(target).cast("bigint").alias(name))


def daily_totals(df: DataFrame, date: str = "date", target: str = "sales") -> DataFrame:
    return totals_by(df, date, target)


def store_totals(df: DataFrame, store: str = "store_id", target: str = "sales") -> DataFrame:
    return totals_by(df, store, target).orderBy(F.asc("sales"), F.asc(store))


def category_share(df: DataFrame, cat: str = "cat_id", target: str = "sales") -> DataFrame:
    """Total and share of the grand total per category (window over the small aggregate)."""
    t = totals_by(df, cat, target)
    return t.withColumn("share", F.col("sales") / F.sum("sales").over(Window.partitionBy()))


def seasonality(df: DataFrame, by: str = "dow", date: str = "date",
                target: str = "sales") -> DataFrame:
    """Mean of ``target`` by day of week (Mon = 0) or by month."""
    key = day_of_week(date) if by == "dow" else F.month(date)
    name = "day_of_week" if by == "dow" else "month"
    return df.groupBy(key.alias(name)).agg(F.avg(F.col(target).cast("double")).alias("mean_value"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns, booleans excluded."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair, pairwise complete, in ONE aggregate.

    Each pair is computed over rows where both values are present; a constant
    column gives NULL (no division by zero). Output: (col_a, col_b, corr).
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    nullable = {f.name for f in df.schema.fields if f.nullable}
    x = {c: F.col(c).cast("double") for c in cols}

    def spread(a: str, b: str) -> Column:
        """Of ``a`` where ``b`` is present; one aggregate per column where ``b`` always is."""
        return F.stddev_samp(F.when(F.col(b).isNotNull(), x[a]) if b != a and b in nullable else x[a])

    exprs = []
    pairs = list(itertools.combinations_with_replacement(cols, 2))
    for i, (a, b) in enumerate(pairs):  # covar_samp skips rows without both values
        exprs.append(F.try_divide(F.covar_samp(x[a], x[b]), spread(a, b) * spread(b, a)).alias(f"p{i}"))
    row = df.agg(*exprs)
    entries = []
    for i, (a, b) in enumerate(pairs):
        entries.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                F.col(f"p{i}").alias("corr")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"),
                                    F.col(f"p{i}").alias("corr")))
    return row.select(F.inline(F.array(*entries)))


def seasonal_decompose(daily: DataFrame, keys: Sequence[str] = (), date: str = "date",
                       value: str = "sales", period: int = 7, min_days: int = 14) -> DataFrame:
    """Additive decomposition with a centred moving average (odd period).

    trend    = mean of the ``period`` values centred on the row (NULL near the ends)
    seasonal = mean of (x - trend) per position mod period, centred to mean 0
    resid    = x - trend - seasonal; rows without a trend are dropped.
    ``daily`` must be gap free (see ``densify_ffill``) and is one row per day
    per key: an aggregate, never the raw panel.
    """
    half = period // 2
    w = Window.partitionBy(*keys).orderBy(date)
    x = F.col(value).cast("double")
    centred = w.rowsBetween(-half, half)
    base = daily.select(
        *keys, date, x.alias("observed"),
        F.when(F.count(x).over(centred) == period, F.avg(x).over(centred)).alias("trend"),
        ((F.row_number().over(w) - 1) % period).alias("_pos"),
        F.count(x).over(Window.partitionBy(*keys)).alias("_n"))
    base = base.where(F.col("_n") >= min_days)
    pos_means = (base.groupBy(*keys, "_pos")
                 .agg(F.avg(F.col("observed") - F.col("trend")).alias("_pm")))
    pos_means = pos_means.withColumn(
        "seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy(*keys)))
    out = base.join(pos_means.select(*keys, "_pos", "seasonal"), [*keys, "_pos"], "left")
    return (out.select(*keys, date, "observed", "trend", "seasonal",
                       (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("resid"))
            .dropna(subset=["trend", "seasonal", "resid"]))


def acf(series: DataFrame, keys: Sequence[str] = ("unique_id",), date: str = "ds",
        value: str = "y", nlags: int = 40) -> DataFrame:
    """Sample autocorrelation per series for lags 0..nlags, with the 1.96/sqrt(n) band.

    acf_k = sum_t (x_t - m)(x_{t-k} - m) / sum_t (x_t - m)^2, all built-in
    windows (one partitioning); output (keys, lag, acf, conf).
    """
    w = Window.partitionBy(*keys).orderBy(date)
    whole = Window.partitionBy(*keys)
    x = F.col(value).cast("double")
    dev = series.select(*keys, date, (x - F.avg(x).over(whole)).alias("_d"))
    prods = [(F.col("_d") * F.lag("_d", k).over(w)).alias(f"_p{k}") for k in range(nlags + 1)]
    p = dev.select(*keys, *prods)
    agg = p.groupBy(*keys).agg(F.count("_p0").alias("n"),
                               *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(nlags + 1)])
    lags = F.array(*[F.struct(F.lit(k).alias("lag"),
                              F.try_divide(F.col(f"_s{k}"), F.col("_s0")).alias("acf"))
                     for k in range(nlags + 1)])
    return (agg.select(*keys, "n", F.inline(lags))
            .where(F.col("lag") < F.col("n"))
            .select(*keys, "lag", "acf", (F.lit(1.96) / F.sqrt("n")).alias("conf")))


def pacf(acf_rows: DataFrame, keys: Sequence[str] = ("unique_id",)) -> DataFrame:
    """Partial autocorrelations from the ACF rows of each series: Durbin-Levinson as a fold over its ACF array.

    Input is the small per-series ACF table (<= nlags + 1 rows per group). Lags
    without a value (a constant series) have no row.
    """
    r = F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"])
    rows = acf_rows.groupBy(*keys).agg(r.alias("_r")).where(F.get("_r", F.lit(0)).isNotNull())

    def step(s: Column, k: Column) -> Column:
        # phi holds the k - 1 coefficients of the order before, v its innovation variance
        known = F.reverse(F.slice("_r", F.lit(2), k - 1))
        gap = F.get("_r", k) - dot(s["phi"], known)

        def longer(a: Column) -> Column:
            phi = F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda x, y: x - a * y), F.array(a))
            return F.struct(phi.alias("phi"), (s["v"] * (1 - a * a)).alias("v"), F.concat(s["out"], F.array(a)).alias("out"))
        return let(F.when(s["v"] > 0, gap / s["v"]), longer)

    start = F.struct(doubles([]).alias("phi"), F.lit(1.0).alias("v"), doubles([1.0]).alias("out"))
    lags = F.transform(indices(F.size("_r") - 1), lambda i: i + 1)
    out = rows.select(*keys, F.posexplode(F.aggregate(lags, start, step, lambda s: s["out"])).alias("lag", "pacf"))
    return out.where("pacf IS NOT NULL")


def path_quantiles(paths: DataFrame, keys: Sequence[str] = ("unique_id", "ds"),
                   value: str = "y") -> DataFrame:
    """Median and 95 % band across sample paths (linear interpolation)."""
    q = F.percentile(F.col(value).cast("double"), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return (paths.groupBy(*keys).agg(q.alias("_q"))
            .select(*keys, F.col("_q")[1].alias("yhat"), F.col("_q")[0].alias("yhat_lower"),
                    F.col("_q")[2].alias("yhat_upper")))


def static_features(df: DataFrame, cols: Sequence[str], series: str = "unique_id",
                    date: str = "ds") -> DataFrame:
    """First value per series of each static column; strings become sorted codes."""
    first = df.groupBy(series).agg(*[F.min_by(c, date).alias(c) for c in cols])
    string_cols = [f.name for f in first.schema.fields
                   if f.name in cols and isinstance(f.dataType, T.StringType)]
    if string_cols:
        from panelcast.operators.reshape import encode_categories
        first = encode_categories(first, string_cols)
    return first


def series_list(df: DataFrame, keys: Sequence[str] = ("item_id", "store_id"),
                k: int | None = None) -> DataFrame:
    """Sorted distinct series keys, optionally the first ``k``."""
    out = df.select(*keys).distinct().orderBy(*keys)
    return out.limit(k) if k is not None else out
