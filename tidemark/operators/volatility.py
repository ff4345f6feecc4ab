"""Bands, true range and rolling volatility."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.fixed import RATIO_GUARD, TRADING_DAYS
from tidemark.functions.numeric import change, full_window, ratio
from tidemark.series import windowed

ANNUAL = TRADING_DAYS**0.5


@windowed(back=lambda window=20, width=2.0: window - 1)
def bollinger(frames, window=20, width=2.0):
    """Rolling mean with bands of ``width`` sample deviations, and two ratios of them."""
    frame = frames.last(window)
    span = F.col("BB_Upper") - F.col("BB_Lower")
    return [
        {"BB_Mid": F.avg("close").over(frame), "_dev": F.stddev_samp("close").over(frame)},
        {
            "BB_Upper": F.col("BB_Mid") + F.col("_dev") * width,
            "BB_Lower": F.col("BB_Mid") - F.col("_dev") * width,
        },
        {
            "BB_Width": ratio(span, F.col("BB_Mid") + RATIO_GUARD),
            "BB_Pct": ratio(F.col("close") - F.col("BB_Lower"), span + RATIO_GUARD),
        },
    ]


@windowed(back=lambda window=14: window)
def atr(frames, window=14):
    """Rolling mean of the true range, also relative to the close."""
    before = F.lag("close").over(frames.order)
    name = f"ATR_{window}"
    true_range = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )
    return [
        {"_true_range": true_range},
        {name: F.avg("_true_range").over(frames.last(window))},
        {"ATR_Norm": ratio(F.col(name), F.col("close") + RATIO_GUARD)},
    ]


def _log_return(frames):
    return {"_log": F.log(ratio("close", F.lag("close").over(frames.order)))}


@windowed(back=21)
def hist_vol(frames):
    """Annualised percent volatility of log returns over 21 rows, shorter at the start."""
    deviation = F.stddev_samp("_log").over(frames.last(21))
    return [_log_return(frames), {"HV_21": deviation * ANNUAL * 100}]


def _full_vol(value, frames, n):
    return full_window(F.stddev_samp(value), value, frames.last(n), n) * ANNUAL


@windowed(back=lambda windows=(5, 21), prefix="HV_": max(windows))
def full_window_vol(frames, windows=(5, 21), prefix="HV_"):
    """Annualised percent volatility of log returns, NULL until the window is full."""
    vols = {f"{prefix}{n}": _full_vol("_log", frames, n) * 100 for n in windows}
    return [_log_return(frames), vols]


@windowed(back=lambda window=30: window)
def rolling_vol_log(frames, window=30):
    """Annualised percent volatility of log returns over a full window."""
    return [_log_return(frames), {f"Vol_Log_{window}": _full_vol("_log", frames, window) * 100}]


@windowed(back=lambda window=30: window)
def rolling_vol_simple(frames, window=30):
    """Annualised volatility of simple percent returns over a full window."""
    percent = change("close", F.lag("close").over(frames.order)) * 100
    return [{"_pct": percent}, {f"Vol_Simple_{window}": _full_vol("_pct", frames, window)}]
