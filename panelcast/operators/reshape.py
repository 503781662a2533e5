"""Reshapes, projections and filters (DataFrame -> DataFrame)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DAY_PREFIX = "d_"


def day_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(DAY_PREFIX)]


def melt_sales(wide: DataFrame, days: Iterable[str] | None = None,
               value_name: str = "sales") -> DataFrame:
    """Wide daily matrix -> long rows ``(ids..., d, sales)``.

    ``days`` restricts the unpivot to some ``d_`` columns *before* the Expand,
    which is the only way the scan can prune the other day columns.
    """
    d_cols = list(days) if days is not None else day_columns(wide)
    ids = [c for c in wide.columns if not c.startswith(DAY_PREFIX) and c != "id"]
    # one generator over an array of (d, value) structs, sent as ONE SQL
    # expression: a Generate node instead of an Expand with one projection per
    # day column (much cheaper to plan and run for ~2,000 columns), and a single
    # call into the JVM instead of one per column.
    body = ", ".join(f"struct('{c}' AS d, CAST(`{c}` AS INT) AS `{value_name}`)" for c in d_cols)
    return wide.selectExpr(*[f"`{c}`" for c in ids], f"inline(array({body}))")


def filter_in(df: DataFrame, **allowed: Sequence | None) -> DataFrame:
    """Keep rows whose column value is in the given list; an empty list means no filter."""
    for col, values in allowed.items():
        if values:
            df = df.where(F.col(col).isin(list(values)))
    return df


def filter_dates(df: DataFrame, lo: dt.date | str, hi: dt.date | str, col: str = "date") -> DataFrame:
    """Inclusive date range filter (pushed down to the scan when possible)."""
    return df.where(F.col(col).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def filter_options(df: DataFrame, stores: str = "store_id", cats: str = "cat_id",
                   date: str = "date") -> DataFrame:
    """Option lists for the filters as (kind, value) rows: stores, categories, date
    bounds. One pass: partial distinct (store, category) pairs with their date bounds,
    then one small aggregate of those pairs."""
    pairs = df.groupBy(stores, cats).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    one = pairs.agg(F.collect_set(stores).alias("s"), F.collect_set(cats).alias("c"),
                    F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def option(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    options = F.concat(F.transform("s", lambda x: option("store", x)), F.transform("c", lambda x: option("category", x)),
                       F.array(option("min_date", F.col("lo")), option("max_date", F.col("hi"))))
    return one.select(F.inline(options))


def split_cutoff(max_date: Column, test_days: int) -> Column:
    """First test day: max(date) - (test_days - 1)."""
    return F.date_sub(max_date, test_days - 1)


def train_test_split(df: DataFrame, test_days: int = 28, date: str = "date",
                     max_date: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """Time split: train = date < cutoff, test = date >= cutoff.

    ``max_date`` may be passed when known (e.g. from the small calendar) so the
    big table is not scanned twice; otherwise it is a scalar subquery.
    """
    if date not in df.columns:
        raise ValueError(f"train_test_split needs a '{date}' column; got {df.columns}")
    if max_date is None:
        max_date = df.agg(F.max(date)).first()[0]
    cut = F.date_sub(F.lit(max_date), test_days - 1)
    return df.where(F.col(date) < cut), df.where(F.col(date) >= cut)


def validation_flag(df: DataFrame, val_days: int = 28, date: str = "date",
                    max_date: dt.date | None = None, name: str = "is_valid") -> DataFrame:
    """Boolean column marking the last ``val_days`` days (for early stopping)."""
    if max_date is None:
        max_date = df.agg(F.max(date)).first()[0]
    return df.withColumn(name, F.col(date) >= F.date_sub(F.lit(max_date), val_days - 1))


def drop_null_target(df: DataFrame, target: str = "sales") -> DataFrame:
    return df.dropna(subset=[target])


def to_series_frame(df: DataFrame, keys: Sequence[str] = ("item_id", "store_id"),
                    date: str = "date", target: str = "sales",
                    keep: Sequence[str] = ()) -> DataFrame:
    """(unique_id, ds, y) frame: unique_id = keys joined by '_', y as double."""
    for c in (*keys, date, target):
        if c not in df.columns:
            raise ValueError(f"missing column '{c}'")
    return df.select(F.concat_ws("_", *keys).alias("unique_id"), F.col(date).alias("ds"),
                     F.col(target).cast("double").alias("y"), *keep)


def melt_metrics(board: DataFrame, model: str = "Model",
                 metrics: Sequence[str] = ("RMSE", "MAE", "MAPE", "sMAPE", "WRMSSE")) -> DataFrame:
    """Leaderboard -> (Model, Metric, Value), training time left out."""
    cols = [m for m in metrics if m in board.columns]
    return board.select(model, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [model], cols, "Metric", "Value")


def clip_nonneg(c: str | Column) -> Column:
    """max(x, 0) that keeps NULL as NULL (greatest() would skip it)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNotNull(), F.greatest(col, F.lit(0.0)))


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Residual = actual - predicted, 2 dp, with its sign class."""
    res = F.round(F.col(actual) - F.col(predicted), 2)
    return df.withColumn("residual", res).withColumn(
        "residual_sign", F.when(res > 0, "under").when(res < 0, "over").otherwise("exact"))


def encode_categories(df: DataFrame, cols: Sequence[str],
                      vocab_source: DataFrame | None = None) -> DataFrame:
    """Replace each string column by its code in sorted order of the distinct values.

    The distinct value list is small (a category vocabulary) and is joined back
    as a small dimension; codes are
    ``dense_rank - 1`` over it. ``vocab_source`` may be a smaller frame holding
    the same values (e.g. the sparse facts rather than the dense panel).
    """
    out = df
    src = vocab_source if vocab_source is not None else df
    for c in cols:
        vocab = src.select(c).where(F.col(c).isNotNull()).distinct()
        vocab = vocab.withColumn(f"{c}__code",
                                 (F.dense_rank().over(Window.orderBy(c)) - 1).cast("int"))
        out = out.join(vocab, c, "left").drop(c).withColumnRenamed(f"{c}__code", c)
    return out


EXCLUDED_FEATURES = (
    # fixed values: columns that are never model inputs
    "sales", "date", "d", "item_id", "store_id", "dept_id", "cat_id", "state_id",
    "wm_yr_wk", "weekday", "wday", "event_name_1", "event_name_2", "event_type_1", "event_type_2",
)


def select_features(df: DataFrame, target: str = "sales",
                    exclude: Sequence[str] = EXCLUDED_FEATURES) -> list[str]:
    """Numeric (and boolean) columns minus the excluded names and the target."""
    out = []
    for f in df.schema.fields:
        if f.name in exclude or f.name == target:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            out.append(f.name)
    return out


def detect_covariates(df: DataFrame, known_future: Sequence[str] = (),
                      observed_past: Sequence[str] = (),
                      candidates: Sequence[str] = ()) -> dict[str, list[str]]:
    """Split the requested covariates into those present in ``df`` (schema
    only, no data is read): known-future, observed-past and regressors."""
    cols = set(df.columns)
    return {"known_future": [c for c in known_future if c in cols],
            "observed_past": [c for c in observed_past if c in cols],
            "regressors": [c for c in candidates if c in cols]}
