"""Indicators against plain pandas over many small blocks, and edge cases by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.util import SCHEMA, expected, level, walk
from tidemark.operators import averages, candles, momentum, running, volatility
from tidemark.plans.features import feature_names, feature_table, indicators
from tidemark.series import with_positions


@pytest.fixture(scope="module")
def walks():
    return [walk("A", 900, 1), walk("B", 431, 2, "2020-05-05"), walk("C", 1, 3), walk("D", 2, 4)]


@pytest.fixture(scope="module")
def bars(spark, walks):
    return spark.createDataFrame(pd.concat(walks), SCHEMA).cache()


@pytest.mark.parametrize("block_rows", [64, 210, 2048])
def test_all_indicators(bars, walks, block_rows):
    table = feature_table(bars, horizon=5, drop_incomplete=False, block_rows=block_rows).toPandas()
    for series in walks:
        ours = table[table["symbol"] == series["symbol"].iloc[0]].sort_values("date")
        theirs = expected(series)
        assert len(ours) == len(series)
        for column in theirs:
            a, b = ours[column].to_numpy(dtype=float), theirs[column].to_numpy(dtype=float)
            assert np.array_equal(np.isnan(a), np.isnan(b)), column
            assert np.allclose(a, b, rtol=1e-8, atol=1e-7, equal_nan=True), column


def test_counts(bars):
    assert len(indicators(bars).columns) == 7 + 46
    table = feature_table(bars, horizon=1)
    assert len(feature_names(table)) == 61
    counts = {r["symbol"]: r["count"] for r in table.groupBy("symbol").count().collect()}
    assert counts == {"A": 900 - 21, "B": 431 - 21}
    assert {"EMA_12", "EMA_26"} <= set(indicators(bars, macd_means=True).columns)


def test_bounds(bars):
    table = indicators(bars).toPandas()
    assert table["RSI_14"].dropna().between(0, 100).all()
    assert table["Williams_R"].between(-100.001, 0.001).all()
    assert np.allclose(table["Stoch_K"], table["Williams_R"] + 100, atol=1e-5)
    upper = table.dropna(subset=["BB_Upper"])
    assert (upper["BB_Lower"] <= upper["BB_Mid"]).all() and (upper["BB_Mid"] <= upper["BB_Upper"]).all()


def test_symbols_do_not_mix(bars):
    alone = indicators(bars.filter("symbol = 'B'")).toPandas().sort_values("date")
    both = indicators(bars).filter("symbol = 'B'").toPandas().sort_values("date")
    pd.testing.assert_frame_equal(
        alone.reset_index(drop=True), both.reset_index(drop=True), rtol=1e-12
    )


def test_positions(bars, walks):
    placed = with_positions(bars).toPandas()
    for series in walks:
        ours = placed[placed["symbol"] == series["symbol"].iloc[0]].sort_values("date")
        assert ours["pos"].tolist() == list(range(1, len(series) + 1))
        assert (ours["n_rows"] == len(series)).all()


def test_flat_rising_and_falling_prices(spark):
    data = pd.concat([level("F", [50] * 30), level("U", range(1, 31)), level("X", range(40, 10, -1))])
    df = spark.createDataFrame(data, SCHEMA)
    last = indicators(df).toPandas().sort_values("date").groupby("symbol").last()
    assert last.loc["F", "RSI_14"] == 0.0 and last.loc["F", "Stoch_K"] == 0.0
    assert last.loc["F", "Williams_R"] == 0.0 and last.loc["F", "CCI"] == 0.0
    assert last.loc["F", "OBV"] == 0.0 and last.loc["F", "BB_Width"] == 0.0
    assert last.loc["U", "RSI_14"] == pytest.approx(100) and last.loc["U", "OBV"] == 290
    assert last.loc["X", "RSI_14"] == pytest.approx(0) and last.loc["X", "OBV"] == -290
    assert last.loc["U", "GoldenCross"] == 0


def test_first_rows_and_zero_close(spark):
    df = spark.createDataFrame(level("Z", [10, 0, 5]), SCHEMA)
    rows = indicators(df).toPandas().sort_values("date").reset_index(drop=True)
    assert np.isnan(rows.loc[0, "RSI_14"]) and np.isnan(rows.loc[0, "BB_Upper"])
    assert rows.loc[0, "SMA_200"] == 10 and rows.loc[0, "EMA_5"] == 10
    assert rows.loc[1, "Daily_Return"] == -1
    assert np.isnan(rows.loc[2, "Daily_Return"])  # division by a zero close gives no value


def test_full_windows(bars, walks):
    vol = volatility.full_window_vol(bars, block_rows=64).toPandas()
    simple = volatility.rolling_vol_simple(bars, block_rows=64).toPandas()
    means = averages.full_window_averages(bars, block_rows=64).toPandas()
    for series in walks:
        s = series["symbol"].iloc[0]
        logs = np.log(series["close"] / series["close"].shift())
        pct = (series["close"] / series["close"].shift() - 1) * 100

        def own(table, column):
            return table[table["symbol"] == s].sort_values("date")[column].to_numpy(dtype=float)

        for n in (5, 21):
            want = (logs.rolling(n).std() * np.sqrt(252) * 100).to_numpy()
            assert np.allclose(own(vol, f"HV_{n}"), want, equal_nan=True)
        want = (pct.rolling(30).std() * np.sqrt(252)).to_numpy()
        assert np.allclose(own(simple, "Vol_Simple_30"), want, equal_nan=True)
        assert np.allclose(own(means, "MA20"), series["close"].rolling(20).mean(), equal_nan=True)


@pytest.mark.parametrize("spans", [(1, 2, 3), (12, 26, 9), (5, 9, 9), (9, 5, 9)])
def test_means_of_unusual_spans(bars, walks, spans):
    table = running.running_columns(bars, spans=[1, 2, 1000], macd=spans).toPandas()
    series = walks[0]
    ours = table[table["symbol"] == "A"].sort_values("date")
    for span in (1, 2, 1000):
        want = series["close"].ewm(span=span, adjust=False).mean()
        assert np.allclose(ours[f"EMA_{span}"], want, rtol=1e-10)
    fast, slow, signal = spans
    c = series["close"]
    line = c.ewm(span=fast, adjust=False).mean() - c.ewm(span=slow, adjust=False).mean()
    want = line.ewm(span=signal, adjust=False).mean()
    assert np.allclose(ours["MACD_Signal"], want, rtol=1e-9, atol=1e-9)


def test_forward_fill(spark):
    data = level("G", range(1, 801), "2020-06-01").astype({"close": float})
    data.loc[data.index % 170 != 5, "close"] = np.nan
    df = spark.createDataFrame(data, SCHEMA).withColumn(
        "close", F.when(~F.isnan("close"), F.col("close"))
    )
    ours = running.forward_fill(df, ["close"]).toPandas().sort_values("date")["close"]
    assert np.allclose(ours.to_numpy(dtype=float), data["close"].ffill(), equal_nan=True)


def test_signals_and_flags(spark):
    df = spark.createDataFrame(level("U", range(1, 31)), SCHEMA)
    rows = momentum.momentum_signals(indicators(df)).toPandas().sort_values("date")
    assert rows["RSI_Signal"].iloc[-1] == "overbought" and rows["RSI_Signal"].iloc[0] is None
    flags = candles.direction_flags(df).toPandas()
    assert set(flags["Body_Direction"]) == {"up"} and set(flags["Change_Direction"]) == {"up"}


@pytest.mark.parametrize("price", [0.1, 123.37])
def test_no_golden_cross_on_flat_prices(spark, price):
    days = pd.bdate_range("2020-01-01", periods=400)
    flat = pd.DataFrame({"symbol": "F", "date": days.date, "open": price, "high": price, "low": price,
                         "close": price, "volume": 1.0})
    crossed = averages.golden_cross(spark.createDataFrame(flat[[f.split(" ")[0] for f in SCHEMA.split(", ")]], SCHEMA))
    assert crossed.filter("GoldenCross = 1").count() == 0
