"""Row guards and the cleaner that writes training snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import BAR_COLUMNS, VALUE_COLUMNS
from tidemark.operators.averages import full_window_averages
from tidemark.operators.candles import target
from tidemark.operators.running import forward_fill
from tidemark.series import in_one_pass


def complete_rows(df: DataFrame, columns=None) -> DataFrame:
    """Rows without any NULL in the given columns."""
    return df.dropna(how="any", subset=columns or [c for c in df.columns if c not in ("symbol", "date")])


def not_empty_rows(df: DataFrame, columns=None) -> DataFrame:
    """Rows with at least one value in the given columns."""
    return df.dropna(how="all", subset=columns or [c for c in df.columns if c not in ("symbol", "date")])


def enough_rows(df: DataFrame, minimum: int) -> DataFrame:
    """Rows of the symbols that have at least ``minimum`` rows."""
    counts = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    keep = counts.filter(F.col("_n") >= minimum).select("symbol")
    return df.join(keep, "symbol", "left_semi")


def training_snapshot(bars: DataFrame) -> DataFrame:
    """Cleaned bars with MA5, MA20 and next-day label, gaps filled forward, incomplete rows dropped.

    The label is taken after the gaps are filled and is never filled itself, so the last row of each
    symbol, which has no next day, is dropped.
    """
    filled = forward_fill(bars.select(*BAR_COLUMNS), VALUE_COLUMNS)
    rows = in_one_pass(filled, [(full_window_averages, {}), (target, {})])
    return complete_rows(rows, [*VALUE_COLUMNS, "MA5", "MA20", "Target"])
