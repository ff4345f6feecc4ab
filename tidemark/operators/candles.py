"""Shape of a bar, its return, lags, label and direction flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import LAG_STEPS, RATIO_GUARD
from tidemark.functions.numeric import change, ratio, sign_flag
from tidemark.series import windowed


def price_action(bars: DataFrame) -> DataFrame:
    """Ranges and shadows of each bar relative to its price; no window."""
    guarded = F.col("close") + RATIO_GUARD
    top, bottom = F.greatest("close", "open"), F.least("close", "open")
    return bars.withColumns(
        {
            "HL_Range": ratio(F.col("high") - F.col("low"), guarded),
            "OC_Range": ratio(F.col("close") - F.col("open"), F.col("open") + RATIO_GUARD),
            "Upper_Shadow": ratio(F.col("high") - top, guarded),
            "Lower_Shadow": ratio(bottom - F.col("low"), guarded),
        }
    )


@windowed(back=1)
def daily_return(frames):
    """Change of the close against the row before, as a fraction."""
    return [{"Daily_Return": change("close", F.lag("close").over(frames.order))}]


@windowed(back=lambda window=20: window - 1)
def volume_ratio(frames, window=20):
    """Volume against its rolling mean."""
    mean = f"Volume_SMA{window}"
    return [
        {mean: F.avg("volume").over(frames.last(window))},
        {"Volume_Ratio": ratio("volume", F.col(mean) + RATIO_GUARD)},
    ]


def lag_name(column: str, step: int) -> str:
    return f"{column[:1].upper()}{column[1:]}_Lag{step}"


@windowed(back=lambda column="close", steps=LAG_STEPS: max(steps))
def lags(frames, column="close", steps=LAG_STEPS):
    """Earlier values of one column."""
    return [{lag_name(column, n): F.lag(column, n).over(frames.order) for n in steps}]


@windowed(back=0, ahead=lambda horizon=1, column="close", name="Target": horizon)
def target(frames, horizon=1, column="close", name="Target"):
    """The label: the value ``horizon`` rows later, NULL on the last rows."""
    return [{name: F.lead(column, horizon).over(frames.order)}]


@windowed(back=1)
def direction_flags(frames):
    """Up or down by bar body and by change of the close (no change counts as up)."""
    body = F.when(F.col("close") >= F.col("open"), "up").otherwise("down")
    moved = F.coalesce("Daily_Return", F.lit(0.0))
    return [
        {**daily_return.stages(frames)[0], "Body_Direction": body},
        {"Change_Direction": sign_flag(moved, up="up", down="down")},
    ]
