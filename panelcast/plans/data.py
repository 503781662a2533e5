"""A handle on the retail views derived from one directory of input tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources import fixtures as fx

# panel rows (by the estimate) and line items that a partition holds, and the number of partitions up to which the planner deals them
PARTITION_ROWS = 250_000
PARTITION_LINES = 250_000
SMALL_PARTITIONS = 8


@dataclass
class RetailData:
    spark: SparkSession
    sf_dir: str
    bounds: tuple[dt.date, dt.date] = field(init=False)
    rows: int = field(init=False)
    lines: int = field(init=False)

    def __post_init__(self) -> None:
        *self.bounds, self.rows, self.lines = fx.panel_size(self.spark, self.sf_dir)

    @property
    def partitions(self) -> int | None:
        """Partitions of the panel, ``PARTITION_ROWS`` of its rows each; a small panel is left to the planner."""
        n = -(-self.rows // PARTITION_ROWS)
        return n if n > SMALL_PARTITIONS else None

    @property
    def line_partitions(self) -> int | None:
        """Partitions of the line items and their daily aggregate, ``PARTITION_LINES`` each; few are left to the planner."""
        n = -(-self.lines // PARTITION_LINES)
        return n if n > SMALL_PARTITIONS else None

    @property
    def day0(self) -> dt.date:
        return self.bounds[0]

    @property
    def last_day(self) -> dt.date:
        return self.bounds[1]

    def cutoff(self, test_days: int = 28) -> dt.date:
        return self.last_day - dt.timedelta(days=test_days - 1)

    def sales_sparse(self) -> DataFrame:
        return fx.sales_sparse(self.spark, self.sf_dir, self.day0, self.line_partitions)

    def sales_long(self, gaps: bool = True) -> DataFrame:
        return fx.sales_long(self.spark, self.sf_dir, self.day0, gaps, self.line_partitions)

    def sales_wide(self) -> DataFrame:
        return fx.sales_wide(self.spark, self.sf_dir, self.bounds, self.line_partitions)

    def calendar(self) -> DataFrame:
        return fx.calendar(self.spark, self.sf_dir)

    def prices(self) -> DataFrame:
        return fx.prices(self.spark, self.sf_dir, self.day0, self.line_partitions)

    def merged(self, fill: bool = False, gaps: bool = True, late: bool = False) -> DataFrame:
        from panelcast.plans.preprocess import merge_all
        return merge_all(self.sales_long(gaps), self.calendar(), self.prices(), fill=fill, partitions=self.partitions, late=late)

    def panel(self, gaps: bool = True, late: bool = False) -> DataFrame:
        """Merged and filled daily panel; ``gaps=False`` has every day of each series. ``late``: for queries that read most
        of the calendar's columns (``merge_all``)."""
        return self.merged(fill=True, gaps=gaps, late=late)

    def series_frame(self, gaps: bool = True) -> DataFrame:
        """(unique_id, ds, y) for every series and day."""
        from panelcast.operators.reshape import to_series_frame
        return to_series_frame(self.panel(gaps))
