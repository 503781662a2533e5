"""Readers for the star-schema parquet tables used as inputs.

Each reader selects only the columns the derived views need, so the parquet
scan's ReadSchema stays narrow and filters can be pushed down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df
