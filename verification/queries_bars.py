"""Registered queries for bars, indicators, lags, calendar, context and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import CALENDAR_COLUMNS, calendar
from tidemark.functions.numeric import sign_flag
from tidemark.operators import averages, candles, momentum, running, volatility
from tidemark.plans.features import feature_names, feature_table, indicators
from tidemark.series import in_one_pass, laid_out
from tidemark.sources.bars import in_range, lineitem_bars, recent
from tidemark.sources.context import join_context, orders_context, read_series, series_returns
from verification.sql_bars import DIGITS, FEATURES, INDICATORS


def rounded(df: DataFrame, *columns: str, keys=("symbol", "date")) -> DataFrame:
    """Keys and columns, each rounded to its comparison digits."""
    return df.select(
        *keys,
        *[F.round(c, DIGITS[c]).alias(c) if c in DIGITS else F.col(c) for c in columns],
    )


def _series(spark, sf_dir):
    context = orders_context(spark, sf_dir)
    return read_series(context, "VIX"), read_series(context, "SP500")


def _with_context(spark, sf_dir):
    return join_context(lineitem_bars(spark, sf_dir), *_series(spark, sf_dir))


def on_bars(operator, *columns, **kwargs):
    return lambda spark, sf_dir: rounded(operator(lineitem_bars(spark, sf_dir), **kwargs), *columns)


def bars(spark, sf_dir):
    return lineitem_bars(spark, sf_dir)


def positions(spark, sf_dir):
    """Bars laid out once, and operators that find their places in the table."""
    out = in_one_pass(laid_out(lineitem_bars(spark, sf_dir)), [(averages.sma, {"windows": [20]}), (candles.daily_return, {})])
    return rounded(out, "pos", "n_rows", "SMA_20", "Daily_Return")


def date_range(spark, sf_dir):
    chosen = in_range(lineitem_bars(spark, sf_dir), ["AF", "NO"], "1996-01-01", "1998-01-01")
    return chosen.select("symbol", "date", "close")


def recent_range(spark, sf_dir):
    return recent(lineitem_bars(spark, sf_dir)).select("symbol", "date", "close")


def hist_vol_full(spark, sf_dir):
    return rounded(volatility.full_window_vol(lineitem_bars(spark, sf_dir)), "HV_5", "HV_21")


def target(spark, sf_dir):
    labels = [(candles.target, {"horizon": h, "name": f"Target_{h}"}) for h in (1, 5, 21)]
    out = in_one_pass(lineitem_bars(spark, sf_dir), labels)
    return out.select("symbol", "date", "Target_1", "Target_5", "Target_21")


def signals(spark, sf_dir):
    oscillators = (momentum.rsi, momentum.stochastic, momentum.williams_r, momentum.cci)
    out = in_one_pass(lineitem_bars(spark, sf_dir), [(op, {}) for op in oscillators])
    out = momentum.momentum_signals(out)
    return rounded(out, "RSI_Signal", "Stoch_Signal", "Williams_Signal", "CCI_Signal")


def macd(spark, sf_dir):
    out = rounded(
        running.macd(lineitem_bars(spark, sf_dir)), "MACD", "MACD_Signal", "MACD_Hist"
    )
    return out.withColumn("Hist_Sign", sign_flag("MACD_Hist"))


def context_vix(spark, sf_dir):
    return rounded(_series(spark, sf_dir)[0], "VIX", keys=("date",))


def context_sp500(spark, sf_dir):
    sp500 = _series(spark, sf_dir)[1]
    out = sp500.join(series_returns(sp500, "SP500", "SP500_Return"), "date")
    return rounded(out, "SP500", "SP500_Return", keys=("date",)).withColumn(
        "SP500", F.round("SP500", 2)
    )


def context_join(spark, sf_dir):
    return rounded(_with_context(spark, sf_dir), "VIX", "SP500_Return")


def context_empty(spark, sf_dir):
    vix, sp500 = _series(spark, sf_dir)
    out = join_context(lineitem_bars(spark, sf_dir), vix.filter("false"), sp500.filter("false"))
    return rounded(out, "VIX", "SP500_Return")


def forward_fill(spark, sf_dir):
    rows = lineitem_bars(spark, sf_dir).select(
        "symbol",
        "date",
        F.when(F.col("volume") > 25, F.col("volume")).alias("volume"),
        F.when(F.col("high") > F.col("low"), F.col("close")).alias("close"),
    )
    return running.forward_fill(rows, ["volume", "close"])


def features(spark, sf_dir):
    return rounded(feature_table(lineitem_bars(spark, sf_dir)), *FEATURES, "Target")


def features_week(spark, sf_dir):
    out = feature_table(lineitem_bars(spark, sf_dir), horizon=5)
    return rounded(out, "RSI_14", "EMA_20", "Close_Lag20", "Target")


def features_context(spark, sf_dir):
    out = feature_table(_with_context(spark, sf_dir), horizon=21)
    return rounded(out, *FEATURES, "VIX", "SP500_Return", "Target")


def feature_counts(spark, sf_dir):
    plain = feature_table(lineitem_bars(spark, sf_dir))
    full = feature_table(_with_context(spark, sf_dir))
    counts = [
        lineitem_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars")),
        plain.groupBy("symbol").agg(F.count("*").alias("feature_rows")),
        full.groupBy("symbol").agg(F.count("*").alias("context_rows")),
    ]
    out = counts[0].join(counts[1], "symbol", "left").join(counts[2], "symbol", "left")
    return out.withColumns(
        {
            "features": F.lit(len(feature_names(plain))),
            "context_features": F.lit(len(feature_names(full))),
        }
    )


QUERIES = {
    "bars": bars,
    "positions": positions,
    "date_range": date_range,
    "recent_range": recent_range,
    "sma": on_bars(averages.sma, *[f"SMA_{n}" for n in (5, 10, 20, 50, 100, 200)]),
    "price_vs_sma": on_bars(
        averages.price_vs_sma, *[f"Price_vs_SMA{n}" for n in (5, 20, 50, 200)]
    ),
    "golden_cross": on_bars(averages.golden_cross, "GoldenCross"),
    "rsi": on_bars(momentum.rsi, "RSI_14", "RSI_7"),
    "stochastic": on_bars(momentum.stochastic, "Stoch_K", "Stoch_D"),
    "williams_r": on_bars(momentum.williams_r, "Williams_R"),
    "cci": on_bars(momentum.cci, "CCI"),
    "roc": on_bars(momentum.roc, "ROC_1", "ROC_5", "ROC_10", "ROC_20"),
    "bollinger": on_bars(
        volatility.bollinger, "BB_Upper", "BB_Mid", "BB_Lower", "BB_Width", "BB_Pct"
    ),
    "atr": on_bars(volatility.atr, "ATR_14", "ATR_Norm"),
    "hist_vol": on_bars(volatility.hist_vol, "HV_21"),
    "hist_vol_full": hist_vol_full,
    "rolling_vol_log": on_bars(volatility.rolling_vol_log, "Vol_Log_30"),
    "rolling_vol_simple": on_bars(volatility.rolling_vol_simple, "Vol_Simple_30"),
    "obv": on_bars(running.obv, "OBV"),
    "volume_ratio": on_bars(candles.volume_ratio, "Volume_SMA20", "Volume_Ratio"),
    "price_action": on_bars(
        candles.price_action, "HL_Range", "OC_Range", "Upper_Shadow", "Lower_Shadow"
    ),
    "daily_return": on_bars(candles.daily_return, "Daily_Return"),
    "lags": on_bars(candles.lags, *[f"Close_Lag{n}" for n in (1, 2, 3, 5, 10, 20)]),
    "lags_of_volume": on_bars(
        candles.lags, "Volume_Lag1", "Volume_Lag7", column="volume", steps=[1, 7]
    ),
    "ma_full_window": on_bars(averages.full_window_averages, "MA5", "MA20"),
    "target": target,
    "direction_flags": on_bars(candles.direction_flags, "Body_Direction", "Change_Direction"),
    "signals": signals,
    "ema": on_bars(running.ema, *[f"EMA_{n}" for n in (5, 10, 20, 50, 100, 200)]),
    "ema_chart": on_bars(running.ema, "EMA_12", "EMA_26", spans=[12, 26]),
    "macd": macd,
    "calendar": on_bars(calendar, *CALENDAR_COLUMNS),
    "indicators": on_bars(indicators, *INDICATORS),
    "context_vix": context_vix,
    "context_sp500": context_sp500,
    "context_join": context_join,
    "context_empty": context_empty,
    "forward_fill": forward_fill,
    "features": features,
    "features_week": features_week,
    "features_context": features_context,
    "feature_counts": feature_counts,
}
