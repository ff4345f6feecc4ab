"""The indicator set and the feature table as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import EMA_SPANS, LAG_STEPS, MACD_SPANS, NOT_FEATURES
from tidemark.functions.calendar import calendar
from tidemark.operators import averages, candles, momentum, volatility
from tidemark.operators.running import running_columns
from tidemark.series import in_one_pass, without_positions

# Indicators whose frames are bounded; one pass over the blocks computes all of them.
_BOUNDED = [
    averages.sma,
    averages.price_vs_sma,
    averages.golden_cross,
    momentum.rsi,
    momentum.stochastic,
    momentum.williams_r,
    momentum.cci,
    momentum.roc,
    volatility.bollinger,
    volatility.atr,
    volatility.hist_vol,
    candles.volume_ratio,
    candles.daily_return,
]

def feature_names(df: DataFrame) -> list[str]:
    """All columns that are not keys, raw prices, label or helpers."""
    return [c for c in df.columns if c.lower() not in NOT_FEATURES and not c.startswith("_")]


def _build(bars, operators, extra_spans, block_rows):
    """Running columns by year, then all bounded columns in one pass over the blocks."""
    spans = [*EMA_SPANS, *(s for s in extra_spans if s not in EMA_SPANS)]
    rows = running_columns(bars, spans=spans, macd=MACD_SPANS, obv=True)
    return without_positions(candles.price_action(in_one_pass(rows, operators, block_rows)))


def indicators(bars: DataFrame, macd_means: bool = False, block_rows: int | None = None):
    """All 46 indicator columns; ``macd_means`` also keeps EMA_12 and EMA_26."""
    operators = [(op, {}) for op in _BOUNDED]
    return _build(bars, operators, MACD_SPANS[:2] if macd_means else (), block_rows)


def feature_table(
    bars: DataFrame,
    horizon: int = 1,
    column: str = "close",
    lag_steps=LAG_STEPS,
    drop_incomplete: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """Indicators, lags, calendar and label; rows with any NULL are dropped unless told otherwise.

    Extra columns of ``bars`` (context series) stay and become features.
    """
    operators = [(op, {}) for op in _BOUNDED]
    operators.append((candles.lags, {"column": column, "steps": lag_steps}))
    operators.append((candles.target, {"column": column, "horizon": horizon}))
    rows = calendar(_build(bars, operators, (), block_rows))
    if not drop_incomplete:
        return rows
    complete = [c for c in rows.columns if c not in ("symbol", "date")]
    return rows.dropna(how="any", subset=complete)


def latest_rows(features: DataFrame) -> DataFrame:
    """The last row of each symbol in a feature table."""
    last = features.groupBy("symbol").agg(F.max("date").alias("date"))
    return features.join(last, ["symbol", "date"], "left_semi")
