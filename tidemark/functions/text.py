"""Text forms of numbers for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N/A"


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def two_digits(value, grouped: bool = False) -> Column:
    """Two decimals, rounded by the exact binary value with ties to even, optionally with separators.

    The JVM formatter rounds the shortest decimal text instead, which differs for values such as 9.575.
    The fraction times 2^52 is a whole number, so the rounding is done in whole numbers.
    """
    value = _column(value)
    size = F.abs(value)
    units = F.floor(size)
    scaled = F.floor((size - units) * float(2**52)) * 100
    cents, rest = F.shiftright(scaled, 52), F.try_mod(scaled, F.lit(2**52))
    odd = F.try_mod(cents, F.lit(2)) == 1
    up = (rest > 2**51) | ((rest == 2**51) & odd)
    cents = cents + up.cast("bigint")
    units = units + F.floor(cents / 100)
    sign = F.when(value < 0, "-").otherwise("")
    form = "%s%,d.%02d" if grouped else "%s%d.%02d"
    text = F.format_string(form, sign, units, F.try_mod(cents, F.lit(100)))
    return F.when(value.isNotNull(), text)


def market_cap(value) -> Column:
    """$ with T, B or M and two digits; whole dollars with separators below a million."""
    value = _column(value)

    def short(unit, suffix):
        return F.concat(F.lit("$"), two_digits(value / unit), F.lit(suffix))

    return (
        F.when(value.isNull(), MISSING)
        .when(value >= 1e12, short(1e12, "T"))
        .when(value >= 1e9, short(1e9, "B"))
        .when(value >= 1e6, short(1e6, "M"))
        .otherwise(F.format_string("$%,d", F.bround(value).cast("bigint")))
    )


def percentage(value) -> Column:
    """A fraction as percent with two digits."""
    value = _column(value)
    text = F.concat(two_digits(value * 100), F.lit("%"))
    return F.when(value.isNull(), MISSING).otherwise(text)


def money(value) -> Column:
    value = _column(value)
    text = F.concat(F.lit("$"), two_digits(value, grouped=True))
    return F.when(value.isNull(), MISSING).otherwise(text)


def signed_percent(value) -> Column:
    value = _column(value)
    plus = F.when(value >= 0, "+").otherwise("")
    return F.concat(plus, two_digits(value), F.lit("%"))


def arrow(value) -> Column:
    """Up or down arrow with the unsigned percent."""
    value = _column(value)
    mark = F.when(value >= 0, "▲ ").otherwise("▼ ")
    return F.concat(mark, two_digits(F.abs(value)), F.lit("%"))


def whole(value) -> Column:
    return F.format_string("%,d", _column(value).cast("bigint"))


def plain_or_missing(value, prefix: str = "") -> Column:
    """All digits of a number, or N/A where it is missing or zero."""
    value = _column(value)
    text = F.concat(F.lit(prefix), value.cast("string"))
    return F.when(value.isNull() | (value == 0), prefix + MISSING).otherwise(text)


def number_or_missing(value, prefix: str = "") -> Column:
    """Two digits, or N/A where the value is missing or zero."""
    value = _column(value)
    text = F.concat(F.lit(prefix), two_digits(value))
    return F.when(value.isNull() | (value == 0), MISSING).otherwise(text)


def rating(value) -> Column:
    """Upper-case rating, or N/A where it is missing or empty."""
    value = _column(value)
    return F.when(value.isNull() | (value == ""), MISSING).otherwise(F.upper(value))
