"""Typed file sources and sinks for the retail data model.

CSV inputs are read with an explicit schema and ``mode=FAILFAST`` (no
inference pass over the data). The wide sales file's day columns are found
from its header line only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

SALES_IDS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
EVENT_COLS = ("event_name_1", "event_type_1", "event_name_2", "event_type_2")

PRICES_SCHEMA = T.StructType([
    T.StructField("store_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("wm_yr_wk", T.IntegerType()),
    T.StructField("sell_price", T.DoubleType()),
])


def _csv(spark: SparkSession, schema: T.StructType):
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("enforceSchema", False))


def require_path(spark: SparkSession, path: str) -> None:
    """Fail early, listing what *is* in the parent folder, when ``path`` is missing."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        return
    parent = hpath.getParent()
    listing = []
    if parent is not None and fs.exists(parent):
        listing = sorted(s.getPath().getName() for s in fs.listStatus(parent))
    raise FileNotFoundError(f"missing input {path}; folder holds: {listing}")


def listing(spark: SparkSession, path: str) -> tuple:
    """(name, length, time) of every file at or below a path: the state of a table's files."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, out = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hpath, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def sales_schema(day_cols: Sequence[str], with_id: bool = True) -> T.StructType:
    ids = SALES_IDS if with_id else SALES_IDS[1:]
    return T.StructType([T.StructField(c, T.StringType()) for c in ids]
                        + [T.StructField(d, T.IntegerType()) for d in day_cols])


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    """Wide sales CSV with short day columns; the column list comes from the header."""
    require_path(spark, path)
    header = spark.read.option("header", True).csv(path).columns
    days = [c for c in header if c.startswith("d_")]
    schema = sales_schema(days, with_id="id" in header)
    return _csv(spark, schema).csv(path)


def calendar_schema(snap_cols: Sequence[str]) -> T.StructType:
    return T.StructType(
        [T.StructField("date", T.DateType()), T.StructField("wm_yr_wk", T.IntegerType()),
         T.StructField("weekday", T.StringType()), T.StructField("wday", T.IntegerType()),
         T.StructField("month", T.IntegerType()), T.StructField("year", T.IntegerType()),
         T.StructField("d", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in EVENT_COLS]
        + [T.StructField(c, T.IntegerType()) for c in snap_cols])


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar CSV: ``date`` parsed, SNAP 0/1 flags -> boolean."""
    require_path(spark, path)
    header = spark.read.option("header", True).csv(path).columns
    snaps = [c for c in header if c.startswith("snap_")]
    df = _csv(spark, calendar_schema(snaps)).option("dateFormat", "yyyy-MM-dd").csv(path)
    return df.withColumns({c: F.col(c).cast("boolean") for c in snaps})


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    require_path(spark, path)
    return _csv(spark, PRICES_SCHEMA).csv(path)


def save_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header (booleans written as 0/1, as in the input files)."""
    out = df.select(*[F.col(f.name).cast("int").alias(f.name)
                      if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
                      for f in df.schema.fields])
    out.write.mode("overwrite").option("header", True).csv(path)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    require_path(spark, path)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def load_first(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
               **options) -> DataFrame:
    """The first of several candidate locations that exists (ordered fallback)."""
    errors = []
    for p in paths:
        try:
            require_path(spark, p)
        except FileNotFoundError as e:
            errors.append(str(e))
            continue
        return spark.read.format(fmt).options(**options).load(p)
    raise FileNotFoundError("; ".join(errors) or "no candidate paths")


def read_as(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table in the format that its name ends in (.csv with a header, .json, else Parquet) as ``schema``: columns
    by name, cast; those that it lacks are NULL."""
    kind = "csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet"
    df = (spark.read.option("header", True) if kind == "csv" else spark.read).format(kind).load(path)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def resolve(spark: SparkSession, candidates: Sequence[str], schema: T.StructType) -> DataFrame:
    """The first candidate that exists, whatever its format, as ``schema``; an error that lists what was looked for."""
    for path in candidates:
        if safe_exists(spark, path):
            return read_as(spark, path, schema)
    raise FileNotFoundError("none of " + ", ".join(candidates))


FORECAST_SCHEMA = T.StructType([T.StructField("date", T.DateType())] + [
    T.StructField(c, T.DoubleType()) for c in ("actual", "predicted", "ci_lower", "ci_upper")])


def forecast_files(folder: str, model: str) -> list[str]:
    """Where a model's daily forecast may lie, in the order in which it is looked for."""
    base, name = folder.rstrip("/"), f"{model.lower()}_forecast"
    return [f"{base}/forecasts/{name}.csv", f"{base}/forecasts/{name}.parquet", f"{base}/{name}.csv"]


def daily_forecast(forecasts: DataFrame, pct: float) -> DataFrame:
    """(date, actual, predicted, ci_lower, ci_upper): totals of all series a day, with a band of ``pct``."""
    total = forecasts.groupBy(F.col("ds").alias("date")).agg(F.sum("y").alias("actual"), F.sum("yhat").alias("predicted"))
    p = F.col("predicted")
    return total.select("date", "actual", "predicted", F.greatest(p - p * pct, F.lit(0.0)).alias("ci_lower"), (p + p * pct).alias("ci_upper"))


def save_forecast_file(daily: DataFrame, path: str) -> None:
    """One model's daily forecast (a row a day) in the format of the name."""
    one = daily.select(*FORECAST_SCHEMA.fieldNames()).coalesce(1)
    save_csv(one, path) if path.endswith(".csv") else save_table(one, path)


def load_forecast_file(spark: SparkSession, folder: str, model: str) -> DataFrame:
    return resolve(spark, forecast_files(folder, model), FORECAST_SCHEMA)


LONG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (*SALES_IDS[1:], "d")] + [T.StructField("sales", T.IntegerType())])


def load_sales_long(spark: SparkSession, folder: str) -> DataFrame:
    """Long sales from the first that exists: processed Parquet, processed CSV, the wide file under raw/, the wide file
    beside it; a wide one is melted."""
    from panelcast.operators.reshape import melt_sales
    base = folder.rstrip("/")
    for path in (f"{base}/processed/sales_long.parquet", f"{base}/processed/sales_long.csv"):
        if safe_exists(spark, path):
            return read_as(spark, path, LONG_SCHEMA)
    for path in (f"{base}/raw/{SALES_FILE}", f"{base}/{SALES_FILE}"):
        if safe_exists(spark, path):
            return melt_sales(load_sales(spark, path)).select(*LONG_SCHEMA.fieldNames())
    raise FileNotFoundError(f"no sales below {folder}")


def save_forecasts(df: DataFrame, path: str) -> None:
    """All forecasters' outputs in one dataset partitioned by model."""
    save_table(df, path, ["model"])


def load_forecast(spark: SparkSession, path: str, model: str) -> DataFrame:
    """One model's forecasts (partition pruning on ``model``), dates as dates."""
    df = load_table(spark, path).where(F.col("model") == model)
    return df.withColumn("ds", F.to_date("ds")) if "ds" in df.columns else df


METRICS_SCHEMA = T.StructType([
    T.StructField("Model", T.StringType()), T.StructField("RMSE", T.DoubleType()),
    T.StructField("MAE", T.DoubleType()), T.StructField("MAPE", T.DoubleType()),
    T.StructField("sMAPE", T.DoubleType()), T.StructField("WRMSSE", T.DoubleType()),
    T.StructField("train_seconds", T.DoubleType()),
])


def load_metrics(spark: SparkSession, csv_path: str | None = None,
                 json_dir: str | None = None) -> DataFrame:
    """Leaderboard CSV if present, else a folder of per-model JSON files whose
    ``Model`` defaults to the file name without extension."""
    if csv_path is not None:
        try:
            require_path(spark, csv_path)
            return _csv(spark, METRICS_SCHEMA).csv(csv_path)
        except FileNotFoundError:
            if json_dir is None:
                raise
    if json_dir is None:
        raise FileNotFoundError("no metrics source given")
    require_path(spark, json_dir)
    value_cols = [c for c in METRICS_SCHEMA.fieldNames() if c != "Model"]
    df = spark.read.json(json_dir)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    model = F.coalesce(F.col("Model").cast("string"), stem) if "Model" in df.columns else stem
    return df.select(model.alias("Model"),
                     *[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c)
                       for c in value_cols])


def save_metrics_json(board: DataFrame, folder: str) -> None:
    """Per-model JSON: the model name is the folder name (``Model=<name>``)."""
    (board.repartition("Model").write.mode("overwrite").partitionBy("Model")
     .json(folder))


def safe_exists(spark: SparkSession, path: str) -> bool:
    try:
        require_path(spark, path)
        return True
    except (FileNotFoundError, AnalysisException):
        return False


def save_insights(tables: dict[str, DataFrame], folder: str) -> None:
    """Write computed insight tables (importances, components, changepoints,
    ACF/PACF...) as one Parquet dataset each under ``folder``."""
    for name, df in tables.items():
        save_table(df, f"{folder.rstrip('/')}/{name}")


def load_insight(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One insight table written by ``save_insights``."""
    return load_table(spark, f"{folder.rstrip('/')}/{name}")


# The input file names of the retail data folder
SALES_FILE = "sales_train_evaluation.csv"
CALENDAR_FILE = "calendar.csv"
PRICES_FILE = "sell_prices.csv"


def load_all(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sales, calendar, prices) as lazy DataFrames; a missing file fails first,
    listing what the folder holds."""
    base = folder.rstrip("/")
    paths = [f"{base}/{n}" for n in (SALES_FILE, CALENDAR_FILE, PRICES_FILE)]
    for p in paths:
        require_path(spark, p)
    return load_sales(spark, paths[0]), load_calendar(spark, paths[1]), load_prices(spark, paths[2])
