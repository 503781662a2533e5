"""Scalar calendar expressions (all JVM-side, codegen friendly).

Day numbering follows the feature definitions: Monday = 0 ... Sunday = 6.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_week(d: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6 (not Spark's dayofweek, which is Sun = 1)."""
    return F.weekday(_c(d))


def day_of_month(d: str | Column) -> Column:
    return F.dayofmonth(_c(d))


def week_of_year(d: str | Column) -> Column:
    """ISO-8601 week number."""
    return F.weekofyear(_c(d))


def is_weekend(d: str | Column) -> Column:
    return (F.weekday(_c(d)) >= 5).cast("int")


def is_month_start(d: str | Column) -> Column:
    return (F.dayofmonth(_c(d)) == 1).cast("int")


def is_month_end(d: str | Column) -> Column:
    return (F.last_day(_c(d)) == _c(d)).cast("int")


def retail_wday(d: str | Column) -> Column:
    """Retail week-day number used by the calendar file: Saturday = 1 ... Friday = 7."""
    return (F.dayofweek(_c(d)) % 7) + 1


def day_name(d: str | Column) -> Column:
    return F.date_format(_c(d), "EEEE")


def calendar_parts(d: str | Column = "date") -> dict[str, Column]:
    """The nine calendar features keyed by output name."""
    return {
        "day_of_week": day_of_week(d),
        "day_of_month": day_of_month(d),
        "week_of_year": week_of_year(d),
        "month": F.month(_c(d)),
        "quarter": F.quarter(_c(d)),
        "year": F.year(_c(d)),
        "is_weekend": is_weekend(d),
        "is_month_start": is_month_start(d),
        "is_month_end": is_month_end(d),
    }
