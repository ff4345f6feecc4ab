"""Seasonal means and yearly performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import MONTH_NAMES
from tidemark.functions.calendar import weekday_name
from tidemark.functions.numeric import sign_flag


def monthly_grid(returns: DataFrame, value: str = "ret_pct") -> DataFrame:
    """Mean return by year (rows) and month (twelve columns)."""
    pivot = (
        returns.select("symbol", F.year("date").alias("year"), F.month("date").alias("month"), value)
        .groupBy("symbol", "year")
        .pivot("month", list(range(1, 13)))
        .agg(F.avg(value))
    )
    names = [F.col(f"`{i}`").alias(n) for i, n in enumerate(MONTH_NAMES, 1)]
    return pivot.select("symbol", "year", *names)


def weekday_means(returns: DataFrame, value: str = "ret_pct") -> DataFrame:
    """Mean return by day of the week."""
    day = F.weekday("date").alias("weekday")
    means = returns.groupBy("symbol", day).agg(F.avg(value).alias("mean_return"))
    return means.withColumn("weekday_name", weekday_name(F.col("weekday")))


def weekday_effect(means: DataFrame) -> DataFrame:
    """Best and worst day and whether they lie more than 0.1 points apart."""
    # Ties go to the earlier day of the week.
    best = F.max_by("weekday_name", F.struct("mean_return", -F.col("weekday")))
    worst = F.min_by("weekday_name", F.struct("mean_return", "weekday"))
    spread = F.max("mean_return") - F.min("mean_return")
    return means.groupBy("symbol").agg(
        best.alias("best_day"),
        F.max("mean_return").alias("best_return"),
        worst.alias("worst_day"),
        F.min("mean_return").alias("worst_return"),
        F.when(spread > 0.1, "Detected").otherwise("Minimal").alias("effect"),
    )


def annual_return(bars: DataFrame) -> DataFrame:
    """Change from the first to the last close of each year in percent, with its sign."""
    ends = bars.groupBy("symbol", F.year("date").alias("year")).agg(
        F.min_by("close", "date").alias("_first"), F.max_by("close", "date").alias("_last")
    )
    change = F.try_divide(F.col("_last") - F.col("_first"), F.col("_first")) * 100
    out = ends.select("symbol", "year", change.alias("annual_return"))
    return out.withColumn("sign", sign_flag("annual_return"))
