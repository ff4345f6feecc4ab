"""Small numeric column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top, bottom) -> Column:
    """Division that gives NULL for a zero denominator."""
    return F.try_divide(top, bottom)


def change(value, before) -> Column:
    """Relative change, as a fraction."""
    return F.try_divide(value, before) - 1


def rise(delta: Column) -> Column:
    """The upward part of a change; NULL stays NULL."""
    return F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))


def fall(delta: Column) -> Column:
    """The downward part of a change as a positive number; NULL stays NULL."""
    return F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))


def full_window(aggregate: Column, value, frame, rows: int) -> Column:
    """A windowed aggregate that needs ``rows`` non-null values in its frame."""
    return F.when(F.count(value).over(frame) >= rows, aggregate.over(frame))


def sample_skewness(value) -> Column:
    """Bias-corrected skewness."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.try_divide(F.skewness(value) * F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(value) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(value).cast("double")
    inner = (n + 1) * F.kurtosis(value) + 6
    return F.when(n > 3, F.try_divide((n - 1) * inner, (n - 2) * (n - 3)))


def band(value, upper, lower) -> Column:
    """overbought above ``upper``, oversold below ``lower``, else neutral; NULL stays NULL."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        F.when(value > upper, "overbought")
        .when(value < lower, "oversold")
        .when(value.isNotNull(), "neutral")
    )


def sign_flag(value, up: str = "positive", down: str = "negative") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value >= 0, up).when(value < 0, down)
