"""Simple moving averages and what is read off them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.fixed import PRICE_VS_SMA_WINDOWS, SMA_WINDOWS
from tidemark.functions.numeric import change, full_window
from tidemark.series import windowed

# Two means of equal prices differ by rounding only; a smaller relative gap than this is a tie.
TIE = 1e-12


@windowed(back=lambda windows=SMA_WINDOWS, value="close": max(windows) - 1)
def sma(frames, windows=SMA_WINDOWS, value="close"):
    """Rolling mean; frames at the start of a series are shorter."""
    return [{f"SMA_{n}": F.avg(value).over(frames.last(n)) for n in windows}]


@windowed(back=max(PRICE_VS_SMA_WINDOWS) - 1)
def price_vs_sma(frames):
    """Close relative to its moving averages."""
    means = sma.stages(frames, windows=PRICE_VS_SMA_WINDOWS)
    return [
        *means,
        {f"Price_vs_SMA{n}": change("close", f"SMA_{n}") for n in PRICE_VS_SMA_WINDOWS},
    ]


@windowed(back=199)
def golden_cross(frames):
    """1 where the 50-row average stands above the 200-row average by more than rounding, else 0."""
    above = F.col("SMA_50") - F.col("SMA_200") > F.abs("SMA_200") * TIE
    return [*sma.stages(frames, windows=(50, 200)), {"GoldenCross": above.cast("int")}]


@windowed(back=lambda windows=(5, 20): max(windows) - 1)
def full_window_averages(frames, windows=(5, 20)):
    """Rolling mean of the close that is NULL until the window is full."""
    return [{f"MA{n}": full_window(F.avg("close"), "close", frames.last(n), n) for n in windows}]
