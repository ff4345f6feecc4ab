"""Calendar columns and date sequences."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import WEEKDAY_NAMES

CALENDAR_COLUMNS = [
    "DayOfWeek",
    "Month",
    "Quarter",
    "DayOfYear",
    "DOW_sin",
    "DOW_cos",
    "Month_sin",
    "Month_cos",
    "WeekOfYear",
]


def calendar(rows: DataFrame) -> DataFrame:
    """Calendar features of ``date``; Monday is 0, weeks are ISO weeks."""
    rows = rows.withColumns(
        {
            "DayOfWeek": F.weekday("date"),
            "Month": F.month("date"),
            "Quarter": F.quarter("date"),
            "DayOfYear": F.dayofyear("date"),
            "WeekOfYear": F.weekofyear("date"),
        }
    )
    day, month = F.col("DayOfWeek") * (2 * pi) / 5, F.col("Month") * (2 * pi) / 12
    return rows.withColumns(
        {
            "DOW_sin": F.sin(day),
            "DOW_cos": F.cos(day),
            "Month_sin": F.sin(month),
            "Month_cos": F.cos(month),
        }
    )


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), day + 1)


def business_days(starts: DataFrame, count: int, start: str = "last_date") -> DataFrame:
    """The next ``count`` weekdays after each row's start date, numbered from 1."""
    # Every span of 2 * count + 7 days holds at least ``count`` weekdays.
    days = F.sequence(F.date_add(start, 1), F.date_add(start, 2 * count + 7))
    weekdays = F.filter(days, lambda d: F.weekday(d) < 5)
    chosen = F.slice(weekdays, 1, count)
    others = [c for c in starts.columns if c != start]
    return starts.select(*others, F.posexplode(chosen).alias("_i", "date")).select(
        *others, (F.col("_i") + 1).alias("step"), "date"
    )


def last_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
