"""Momentum oscillators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import (
    CCI_BANDS,
    RATIO_GUARD,
    ROC_STEPS,
    RSI_BANDS,
    RSI_WINDOWS,
    STOCHASTIC_BANDS,
    WILLIAMS_BANDS,
)
from tidemark.functions.numeric import band, change, fall, ratio, rise
from tidemark.series import windowed


@windowed(back=lambda windows=RSI_WINDOWS, value="close": max(windows))
def rsi(frames, windows=RSI_WINDOWS, value="close"):
    """Relative strength from plain rolling means of gains and losses."""
    delta, gain, loss = (f"_{part}_{value}" for part in ("delta", "gain", "loss"))

    def strength(n):
        up, down = F.avg(gain).over(frames.last(n)), F.avg(loss).over(frames.last(n))
        return 100 - ratio(F.lit(100.0), 1 + ratio(up, down + RATIO_GUARD))

    return [
        {delta: F.col(value) - F.lag(value).over(frames.order)},
        {gain: rise(F.col(delta)), loss: fall(F.col(delta))},
        {f"RSI_{n}": strength(n) for n in windows},
    ]


def _range(frames, n):
    """Lowest low and highest high of the last ``n`` rows."""
    return {
        f"_low_{n}": F.min("low").over(frames.last(n)),
        f"_high_{n}": F.max("high").over(frames.last(n)),
    }


def _spread(n):
    return F.col(f"_high_{n}") - F.col(f"_low_{n}") + RATIO_GUARD


@windowed(back=lambda k_window=14, d_window=3: k_window + d_window - 2)
def stochastic(frames, k_window=14, d_window=3):
    """Place of the close in its recent range, and the mean of that."""
    height = (F.col("close") - F.col(f"_low_{k_window}")) * 100
    return [
        _range(frames, k_window),
        {"Stoch_K": ratio(height, _spread(k_window))},
        {"Stoch_D": F.avg("Stoch_K").over(frames.last(d_window))},
    ]


@windowed(back=lambda window=14: window - 1)
def williams_r(frames, window=14):
    """Distance of the close from the recent high, from -100 to 0."""
    depth = (F.col(f"_high_{window}") - F.col("close")) * -100
    return [_range(frames, window), {"Williams_R": ratio(depth, _spread(window))}]


@windowed(back=lambda window=20: 2 * (window - 1))
def cci(frames, window=20):
    """Typical price against its mean, in units of the mean distance from each day's own mean."""
    frame = frames.last(window)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    gap, spread = F.col("_gap"), F.col("_gap_spread")
    return [
        {"_gap": typical - F.avg(typical).over(frame)},
        {"_gap_spread": F.avg(F.abs(gap)).over(frame)},
        {"CCI": ratio(gap, spread * 0.015 + RATIO_GUARD)},
    ]


@windowed(back=lambda steps=ROC_STEPS: max(steps))
def roc(frames, steps=ROC_STEPS):
    """Percent change over n rows."""
    return [{f"ROC_{n}": change("close", F.lag("close", n).over(frames.order)) * 100 for n in steps}]


def momentum_signals(indicators: DataFrame) -> DataFrame:
    """Threshold bands of the four oscillators; needs their columns."""
    return indicators.withColumns(
        {
            "RSI_Signal": band("RSI_14", *RSI_BANDS),
            "Stoch_Signal": band("Stoch_K", *STOCHASTIC_BANDS),
            "Williams_Signal": band("Williams_R", *WILLIAMS_BANDS),
            "CCI_Signal": band("CCI", *CCI_BANDS),
        }
    )
