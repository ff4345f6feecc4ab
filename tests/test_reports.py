"""Ranks, histograms, texts, dates, sources and sinks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.util import SCHEMA, level, walk
from tidemark.fixed import FEATURE_GROUPS
from tidemark.functions import text
from tidemark.functions.calendar import business_days
from tidemark.operators import cleaning, importance, keyfigures, stats
from tidemark.sources import bars as source
from tidemark.sources.context import company_facts, join_context
from tidemark.sources.sinks import write_bars, write_snapshot
from tidemark.streaming.live import bars_from_ticks, write_live


def test_ranks_with_many_ties(spark):
    values = [0.0] * 400 + [float(i % 37) for i in range(500)]
    data = pd.DataFrame({"symbol": "S", "date": pd.date_range("2020-01-01", periods=900).date, "v": values})
    out = stats.with_rank(spark.createDataFrame(data), "v").toPandas().sort_values("rank")
    assert out["rank"].tolist() == list(range(1, 901))
    assert out["v"].is_monotonic_increasing and (out["n_ranked"] == 900).all()


def test_ranks_in_small_parts(spark):
    """Parts that are too large are cut again; ties, missing values and short keys keep their places."""
    rng = np.random.default_rng(3)
    days = pd.date_range("2015-01-01", periods=1500).date
    parts = [
        pd.DataFrame({"symbol": "A", "date": days, "v": np.exp(6 * rng.normal(size=1500)).round(3)}),
        pd.DataFrame({"symbol": "B", "date": days, "v": np.where(rng.random(1500) < 0.6, 7.0, rng.integers(0, 90, 1500))}),
        pd.DataFrame({"symbol": "C", "date": days[:9], "v": np.arange(9.0)}),
    ]
    table = spark.createDataFrame(pd.concat(parts), "symbol string, date date, v double")
    table = table.unionByName(table.filter("symbol = 'C'").withColumns({"symbol": F.lit("D"), "v": F.lit(None).cast("double")}))
    for rows in (40, 400, 4096):
        out = stats.with_rank(table, "v", rows=rows).toPandas()
        for symbol, own in out.groupby("symbol"):
            own = own.sort_values("rank")
            assert own["rank"].tolist() == list(range(1, len(own) + 1)) and (own["n_ranked"] == len(own)).all()
            assert own["v"].is_monotonic_increasing or symbol == "D"


def test_quantile_plot_of_normal_values(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame(
        {
            "symbol": "S",
            "date": pd.date_range("2020-01-01", periods=500).date,
            "ret_pct": 3 + 2 * rng.normal(size=500),
        }
    )
    points = stats.quantile_plot(spark.createDataFrame(data))
    first = points.filter("rank = 1").first()
    assert first["position"] == pytest.approx(1 - 0.5 ** (1 / 500))
    line = stats.quantile_line(points).first()
    assert line["slope"] == pytest.approx(2, abs=0.2) and line["intercept"] == pytest.approx(3, abs=0.2)
    assert line["r"] > 0.99


def test_moments_are_bias_corrected(spark):
    values = [1.0, 2.0, 2.5, 7.0, -3.0, 0.5]
    data = pd.DataFrame({"symbol": "S", "ret_pct": values})
    row = stats.moments(spark.createDataFrame(data)).first()
    series = pd.Series(values)
    assert row["skewness"] == pytest.approx(series.skew())
    assert row["kurtosis"] == pytest.approx(series.kurtosis())


def test_histogram_keeps_all_rows_and_empty_bins(spark):
    data = pd.DataFrame({"symbol": "S", "ret_pct": [0.0, 0.1, 10.0, 10.0]})
    rows = stats.histogram(spark.createDataFrame(data), 5).toPandas().sort_values("bin")
    assert rows["count"].tolist() == [2, 0, 0, 0, 2]


def test_number_texts(spark):
    rng = np.random.default_rng(1)
    values = [9.575, 0.125, 1.005, 2.675, 0.0, 999.995, 1e9, 0.004999, 123456.785]
    values += [round(float(x), 3) for x in rng.uniform(0, 2000, 500)]
    rows = spark.createDataFrame([(v,) for v in values + [-v for v in values if v > 0.01]], "v double")
    out = rows.select(
        "v", text.two_digits("v").alias("a"), text.money(F.abs("v")).alias("b"), text.signed_percent("v").alias("c")
    )
    for row in out.collect():
        assert row["a"] == f"{row['v']:.2f}"
        assert row["b"] == f"${abs(row['v']):,.2f}"
        assert row["c"] == f"{row['v']:+.2f}%"
    caps = {None: "N/A", 2.5e12: "$2.50T", 9_575_000.0: "$9.57M", 3.2e9: "$3.20B", 12345.0: "$12,345"}
    rows = spark.createDataFrame([(k,) for k in caps], "v double")
    for row in rows.select("v", text.market_cap("v").alias("t")).collect():
        assert row["t"] == caps[row["v"]]


def test_business_days(spark):
    start = spark.createDataFrame([("S", pd.Timestamp("2026-04-17").date())], "symbol string, last_date date")
    got = [r["date"] for r in business_days(start, 30).orderBy("step").collect()]
    want = pd.bdate_range("2026-04-18", periods=30).date.tolist()
    assert got == want


def test_key_figures_of_short_series(spark):
    df = spark.createDataFrame(pd.concat([level("A", [5.0]), level("B", [4.0, 5.0])]), SCHEMA)
    rows = {r["symbol"]: r for r in keyfigures.key_figures(df).collect()}
    assert rows["A"]["change_pct"] == 0 and rows["A"]["prev_close"] == 5
    assert rows["B"]["change_pct"] == 25 and rows["B"]["direction"] == "positive"


def test_feature_groups(spark):
    names = ["SMA_5", "Close_Lag3", "Volume_Ratio", "SP500_Return", "DOW_sin", "Price_vs_SMA5", "HV_21"]
    df = spark.createDataFrame([(n,) for n in names], "feature string")
    got = {r["feature"]: r["g"] for r in df.select("feature", importance.group_of().alias("g")).collect()}
    for name in names:
        assert got[name] == [g for g, parts in FEATURE_GROUPS.items() if any(p in name for p in parts)]


def test_context_fill_and_defaults(spark):
    df = spark.createDataFrame(level("A", [1, 2, 3, 4], "2021-01-01"), SCHEMA)
    day = F.col("date").cast("date")
    vix = spark.createDataFrame([("2021-01-02", 15.0)], "date string, VIX double").withColumn("date", day)
    sp = spark.createDataFrame(
        [("2021-01-01", 10.0), ("2021-01-03", 11.0)], "date string, SP500 double"
    ).withColumn("date", day)
    rows = join_context(df, vix, sp).orderBy("date").collect()
    assert [r["VIX"] for r in rows] == [None, 15.0, 15.0, 15.0]
    assert [round(r["SP500_Return"], 6) for r in rows] == [0.0, 0.0, 0.1, 0.0]
    empty = join_context(df, vix.limit(0), sp.limit(0)).collect()
    assert {(r["VIX"], r["SP500_Return"]) for r in empty} == {(20.0, 0.0)}


def test_company_defaults(spark):
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    facts = spark.createDataFrame([("A", "Acme", 2.0)], "symbol string, longName string, beta double")
    rows = {r["symbol"]: r for r in company_facts(symbols, facts).collect()}
    assert rows["A"]["longName"] == "Acme" and rows["B"]["longName"] == "B"
    assert rows["B"]["sector"] == "N/A" and rows["B"]["beta"] is None
    sheet = {r["symbol"]: r for r in keyfigures.fact_sheet(company_facts(symbols, facts)).collect()}
    assert sheet["A"]["beta_flag"] and sheet["A"]["beta_text"] == "2.00"
    assert sheet["B"]["market_cap"] == "N/A" and sheet["B"]["analyst_rating"] == "N/A"


def test_round_trips_and_pruning(spark, tmp_path):
    data = pd.concat([walk("A", 120, 1), walk("B", 90, 2)])
    df = spark.createDataFrame(data, SCHEMA)
    path = str(tmp_path / "bars")
    write_bars(df, path)
    back = source.read_bars(spark, path, symbols=["A"], start="2020-01-01")
    plan = back._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PartitionFilters: [symbol" in plan.replace("isnotnull(symbol", "symbol") and "PushedFilters" in plan
    assert back.count() == (data[data["symbol"] == "A"]["date"] >= pd.Timestamp("2020-01-01").date()).sum()
    with pytest.raises(source.NoData):
        source.read_bars(spark, path, symbols=["nobody"], must_exist=True)
    snapshot = cleaning.training_snapshot(df)
    write_snapshot(snapshot, str(tmp_path / "csv"))
    again = source.read_snapshot(spark, str(tmp_path / "csv"))
    assert again.count() == snapshot.count() == 120 + 90 - 2 * 20
    one = source.read_snapshot(spark, str(tmp_path / "csv" / "symbol=A"), symbol="A")
    assert one.columns == source.BAR_SCHEMA.fieldNames() and one.count() == 100


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    ticks = pd.DataFrame(
        {
            "symbol": rng.choice(["A", "B"], 400),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(400) * 613, unit="s"),
            "price": rng.uniform(1, 9, 400).round(2),
            "size": 1.0,
        }
    )
    df = spark.createDataFrame(ticks)
    df.repartition(4).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ticks"))
    live = bars_from_ticks(stream, "1 hour", "10 minutes")
    query = write_live(live, str(tmp_path / "live"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "live")).select(live.columns).collect()}
    want = {tuple(r) for r in bars_from_ticks(df, "1 hour").collect()}
    last = max(ticks["ts"]) - pd.Timedelta("10min")
    closed = {r for r in want if r[1] + pd.Timedelta("1h") <= last}
    assert got == closed and len(got) > 20


def test_universe_and_default_range(spark):
    df = spark.createDataFrame(pd.concat([level("AAPL", [1, 2]), level("XXXX", [1, 2])]), SCHEMA)
    symbols = source.universe(spark)
    assert symbols.count() == 11
    kept = source.in_universe(df, symbols).select("symbol").distinct().collect()
    assert [r["symbol"] for r in kept] == ["AAPL"]
    start, end = source.default_range(F.lit("2026-04-20").cast("date"))
    row = symbols.select((F.datediff(end, start)).alias("days")).first()
    assert row["days"] == 1825
    assert source.recent(df, days=0).count() == 2
