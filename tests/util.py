"""Small series for tests and plain pandas forms of the indicators."""

import numpy as np
import pandas as pd

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def walk(symbol, n, seed, start="2019-11-20"):
    """A random walk with gaps in the dates."""
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(size=n).cumsum().round(2)
    close = np.maximum(close, 1.0)
    open_ = (close + rng.normal(size=n)).round(2)
    high = np.maximum(open_, close) + rng.uniform(0, 2, n).round(2)
    low = np.minimum(open_, close) - rng.uniform(0, 1, n).round(2)
    days = pd.to_datetime(start) + pd.to_timedelta(np.cumsum(rng.integers(1, 4, n)), unit="D")
    volume = rng.integers(1, 1000, n).astype(float)
    return frame(symbol, days, open_, high, low, close, volume)


def frame(symbol, days, open_, high, low, close, volume):
    return pd.DataFrame(
        {
            "symbol": symbol,
            "date": pd.to_datetime(days).date,
            "open": open_,
            "high": high,
            "low": low,
            "close": close,
            "volume": volume,
        }
    ).astype({c: float for c in ("open", "high", "low", "close", "volume")})


def level(symbol, closes, start="2021-03-01"):
    """Bars whose four prices are equal."""
    closes = np.array(closes, dtype=float)
    days = pd.date_range(start, periods=len(closes))
    return frame(symbol, days, closes, closes, closes, closes, np.full(len(closes), 10.0))


def expected(bars):
    """Indicator columns of one symbol by plain pandas."""
    c, h, l, o, v = (bars[x] for x in ("close", "high", "low", "open", "volume"))
    out = pd.DataFrame(index=bars.index)

    def roll(x, n, need=1):
        return x.rolling(n, min_periods=need)

    for n in (5, 10, 20, 50, 100, 200):
        out[f"SMA_{n}"] = roll(c, n).mean()
        out[f"EMA_{n}"] = c.ewm(span=n, adjust=False).mean()
    delta = c.diff()
    for n in (14, 7):
        up, down = roll(delta.clip(lower=0), n).mean(), roll((-delta).clip(lower=0), n).mean()
        out[f"RSI_{n}"] = 100 - 100 / (1 + up / (down + 1e-9))
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    out["MACD"], out["MACD_Signal"] = line, line.ewm(span=9, adjust=False).mean()
    out["MACD_Hist"] = out["MACD"] - out["MACD_Signal"]
    low, high = roll(l, 14).min(), roll(h, 14).max()
    out["Stoch_K"] = 100 * (c - low) / (high - low + 1e-9)
    out["Stoch_D"] = roll(out["Stoch_K"], 3).mean()
    out["Williams_R"] = -100 * (high - c) / (high - low + 1e-9)
    typical = (h + l + c) / 3
    gap = typical - roll(typical, 20).mean()
    out["CCI"] = gap / (0.015 * roll(gap.abs(), 20).mean() + 1e-9)
    for n in (1, 5, 10, 20):
        out[f"ROC_{n}"] = (c / c.shift(n) - 1) * 100
        out[f"Close_Lag{n}"] = c.shift(n)
    dev = roll(c, 20).std()
    out["BB_Upper"], out["BB_Lower"] = out["SMA_20"] + 2 * dev, out["SMA_20"] - 2 * dev
    out["BB_Pct"] = (c - out["BB_Lower"]) / (out["BB_Upper"] - out["BB_Lower"] + 1e-9)
    true = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    out["ATR_14"] = roll(true, 14).mean()
    logs = np.log(c / c.shift())
    out["HV_21"] = roll(logs, 21).std() * np.sqrt(252) * 100
    out["OBV"] = (np.sign(delta) * v).fillna(0).cumsum()
    out["Volume_Ratio"] = v / (roll(v, 20).mean() + 1e-9)
    out["Daily_Return"] = c / c.shift() - 1
    out["Upper_Shadow"] = (h - np.maximum(c, o)) / (c + 1e-9)
    out["Target"] = c.shift(-5)
    return out
