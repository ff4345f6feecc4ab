"""SQL for bars, indicators, lags, calendar, context and features."""

from __future__ import annotations

BARS = """
ticks AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date,
         floor(l_extendedprice * 100 / nullif(l_quantity, 0)) AS px, l_quantity AS q,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k
  FROM lineitem),
bars AS (
  SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, k) AS "close", sum(q) AS volume
  FROM ticks GROUP BY symbol, date)"""

W = "PARTITION BY symbol ORDER BY date"


def last(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def rsi(n: int) -> str:
    return f"(100 - 100 / (1 + avg(gain) {last(n)} / (avg(loss) {last(n)} + 1e-9)))"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {last(n)} >= {n} THEN {agg}({x}) {last(n)} END"


# First layer: everything that reads raw bars only.
LAYER_1 = f"""
l1 AS (
  SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n,
    lag("close") OVER ({W}) AS prev,
    {", ".join(f'avg("close") {last(k)} AS SMA_{k}' for k in (5, 10, 20, 50, 100, 200))},
    stddev_samp("close") {last(20)} AS dev20,
    min(low) {last(14)} AS lo14, max(high) {last(14)} AS hi14,
    (high + low + "close") / 3 AS tp,
    avg(volume) {last(20)} AS Volume_SMA20,
    {", ".join(f'lag("close", {k}) OVER ({W}) AS back{k}' for k in (1, 2, 3, 5, 10, 20))}
  FROM bars)"""

LAYER_2 = f"""
l2 AS (
  SELECT *,
    CASE WHEN prev IS NOT NULL THEN greatest("close" - prev, 0) END AS gain,
    CASE WHEN prev IS NOT NULL THEN greatest(prev - "close", 0) END AS loss,
    CASE WHEN prev IS NULL THEN high - low
         ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr,
    ln("close" / nullif(prev, 0)) AS lr,
    ("close" / nullif(prev, 0) - 1) * 100 AS pct,
    coalesce(sign("close" - prev) * volume, 0) AS signed_volume,
    tp - avg(tp) {last(20)} AS tp_gap,
    100 * ("close" - lo14) / (hi14 - lo14 + 1e-9) AS Stoch_K,
    SMA_20 + 2 * dev20 AS BB_Upper, SMA_20 - 2 * dev20 AS BB_Lower
  FROM l1)"""

LAYER_3 = f"""
l3 AS (
  SELECT *,
    {div('"close"', "SMA_5")} - 1 AS Price_vs_SMA5, {div('"close"', "SMA_20")} - 1 AS Price_vs_SMA20,
    {div('"close"', "SMA_50")} - 1 AS Price_vs_SMA50,
    {div('"close"', "SMA_200")} - 1 AS Price_vs_SMA200,
    CAST(SMA_50 > SMA_200 AS INTEGER) AS GoldenCross,
    {rsi(14)} AS RSI_14, {rsi(7)} AS RSI_7,
    avg(Stoch_K) {last(3)} AS Stoch_D,
    -100 * (hi14 - "close") / (hi14 - lo14 + 1e-9) AS Williams_R,
    tp_gap / (0.015 * avg(abs(tp_gap)) {last(20)} + 1e-9) AS CCI,
    ("close" / nullif(back1, 0) - 1) * 100 AS ROC_1, ("close" / nullif(back5, 0) - 1) * 100 AS ROC_5,
    ("close" / nullif(back10, 0) - 1) * 100 AS ROC_10,
    ("close" / nullif(back20, 0) - 1) * 100 AS ROC_20,
    SMA_20 AS BB_Mid,
    (BB_Upper - BB_Lower) / (SMA_20 + 1e-9) AS BB_Width,
    ("close" - BB_Lower) / (BB_Upper - BB_Lower + 1e-9) AS BB_Pct,
    avg(tr) {last(14)} AS ATR_14, avg(tr) {last(14)} / ("close" + 1e-9) AS ATR_Norm,
    stddev_samp(lr) {last(21)} * sqrt(252) * 100 AS HV_21,
    {full("stddev_samp", "lr", 5)} * sqrt(252) * 100 AS HVF_5,
    {full("stddev_samp", "lr", 21)} * sqrt(252) * 100 AS HVF_21,
    {full("stddev_samp", "lr", 30)} * sqrt(252) * 100 AS Vol_Log_30,
    {full("stddev_samp", "pct", 30)} * sqrt(252) AS Vol_Simple_30,
    sum(signed_volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS OBV,
    volume / (Volume_SMA20 + 1e-9) AS Volume_Ratio,
    (high - low) / ("close" + 1e-9) AS HL_Range, ("close" - open) / (open + 1e-9) AS OC_Range,
    (high - greatest("close", open)) / ("close" + 1e-9) AS Upper_Shadow,
    (least("close", open) - low) / ("close" + 1e-9) AS Lower_Shadow,
    "close" / nullif(prev, 0) - 1 AS Daily_Return,
    back1 AS Close_Lag1, back2 AS Close_Lag2, back3 AS Close_Lag3, back5 AS Close_Lag5,
    back10 AS Close_Lag10, back20 AS Close_Lag20,
    CAST(isodow(date) - 1 AS INTEGER) AS DayOfWeek, CAST(month(date) AS INTEGER) AS Month,
    CAST(quarter(date) AS INTEGER) AS Quarter, CAST(dayofyear(date) AS INTEGER) AS DayOfYear,
    sin(2 * pi() * (isodow(date) - 1) / 5) AS DOW_sin, cos(2 * pi() * (isodow(date) - 1) / 5) AS DOW_cos,
    sin(2 * pi() * month(date) / 12) AS Month_sin, cos(2 * pi() * month(date) / 12) AS Month_cos,
    CAST(week(date) AS INTEGER) AS WeekOfYear
  FROM l2)"""

SPANS = {5: "EMA_5", 10: "EMA_10", 20: "EMA_20", 50: "EMA_50", 100: "EMA_100", 200: "EMA_200",
         12: "EMA_12", 26: "EMA_26"}


def _step(span: int, name: str) -> str:
    return f"(1 - 2.0 / ({span} + 1)) * e.{name} + (2.0 / ({span} + 1)) * b.x AS {name}"


_FAST, _SLOW = (_step(s, f"EMA_{s}").rsplit(" AS ", 1)[0] for s in (12, 26))
EMA = f"""
numbered AS MATERIALIZED (
  SELECT symbol, date, "close" AS x, row_number() OVER ({W}) AS rn FROM bars),
e AS (
  SELECT symbol, rn, {", ".join(f"x AS {v}" for v in SPANS.values())}, x - x AS MACD_Signal
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, {", ".join(_step(s, v) for s, v in SPANS.items())},
    (1 - 2.0 / 10) * e.MACD_Signal + (2.0 / 10) * (({_FAST}) - ({_SLOW})) AS MACD_Signal
  FROM e JOIN numbered b ON b.symbol = e.symbol AND b.rn = e.rn + 1),
means AS (
  SELECT symbol, rn, {", ".join(SPANS.values())}, EMA_12 - EMA_26 AS MACD, MACD_Signal,
    EMA_12 - EMA_26 - MACD_Signal AS MACD_Hist
  FROM e)"""

CONTEXT = """
ctx AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'VIX' ELSE 'SP500' END AS series,
         avg(floor(o_totalprice * 100)) AS v
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL),
sp AS (
  SELECT date, v / lag(v) OVER (ORDER BY date) - 1 AS SP500_Return FROM ctx WHERE series = 'SP500'),
with_context AS (
  SELECT b.symbol, b.date,
    last_value(c.v IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VIX,
    coalesce(sp.SP500_Return, 0.0) AS SP500_Return
  FROM bars b LEFT JOIN (SELECT date, v FROM ctx WHERE series = 'VIX') c USING (date)
  LEFT JOIN sp USING (date))"""

# Digits to which columns are compared; price-scale columns get two, ratios six.
RAW = ["open", "high", "low", "close", "volume"]
PRICE = [
    *[f"EMA_{n}" for n in (5, 10, 20, 50, 100, 200)],
    "MACD", "MACD_Signal", "MACD_Hist", "BB_Upper", "BB_Lower",
]
EXACT = [
    *[f"Close_Lag{n}" for n in (1, 2, 3, 5, 10, 20)],
    "OBV", "GoldenCross", "DayOfWeek", "Month", "Quarter", "DayOfYear", "WeekOfYear",
]
MEAN = [*[f"SMA_{n}" for n in (5, 10, 20, 50, 100, 200)], "BB_Mid", "ATR_14", "Volume_SMA20"]
RATIO = [
    "Price_vs_SMA5", "Price_vs_SMA20", "Price_vs_SMA50", "Price_vs_SMA200",
    "RSI_14", "RSI_7", "Stoch_K", "Stoch_D", "Williams_R", "CCI",
    "ROC_1", "ROC_5", "ROC_10", "ROC_20", "BB_Width", "BB_Pct", "ATR_Norm", "HV_21",
    "Volume_Ratio", "HL_Range", "OC_Range", "Upper_Shadow", "Lower_Shadow", "Daily_Return",
    "DOW_sin", "DOW_cos", "Month_sin", "Month_cos",
]
DIGITS = {
    **{c: 2 for c in PRICE}, **{c: 4 for c in MEAN}, **{c: 6 for c in RATIO},
    "VIX": 2, "SP500_Return": 6, "EMA_12": 2, "EMA_26": 2,
    "HV_5": 6, "Vol_Log_30": 6, "Vol_Simple_30": 6, "MA5": 4, "MA20": 4,
}
INDICATORS = [c for c in PRICE + MEAN + RATIO + ["OBV", "GoldenCross"] if not c.endswith(("_sin", "_cos"))]
FEATURES = PRICE + MEAN + RATIO + EXACT


def pick(columns, prefix: str = "") -> str:
    """Select list with the rounding of each column."""
    out = []
    for c in columns:
        source = f'{prefix}"{c}"'
        out.append(f"round({source}, {DIGITS[c]}) AS {c}" if c in DIGITS else f"{source} AS {c}")
    return ", ".join(out)


LAYERS = f"{BARS}, {LAYER_1}, {LAYER_2}, {LAYER_3}"


def bounded(columns, where: str = "") -> str:
    return f'WITH {LAYERS} SELECT symbol, date, {pick(columns)} FROM l3 {where}'


ALL_ROWS = f"""
WITH RECURSIVE {LAYERS}, {EMA}, {CONTEXT},
wide AS (
  SELECT l3.*, means.* EXCLUDE (symbol, rn), c.VIX, c.SP500_Return,
    lead("close", 1) OVER (PARTITION BY l3.symbol ORDER BY l3.date) AS next1,
    lead("close", 5) OVER (PARTITION BY l3.symbol ORDER BY l3.date) AS next5,
    lead("close", 21) OVER (PARTITION BY l3.symbol ORDER BY l3.date) AS next21
  FROM l3 JOIN means USING (symbol, rn) JOIN with_context c USING (symbol, date))"""

SQL = {
    "bars": f'WITH {BARS} SELECT symbol, date, open, high, low, "close", volume FROM bars',
    "positions": f"""WITH {LAYERS} SELECT symbol, date, rn AS pos, n AS n_rows, {pick(["SMA_20", "Daily_Return"])} FROM l3""",
    "date_range": f"""WITH {BARS} SELECT symbol, date, "close" FROM bars
        WHERE symbol IN ('AF', 'NO') AND date >= DATE '1996-01-01' AND date < DATE '1998-01-01'""",
    "recent_range": f"""WITH {BARS} SELECT symbol, date, "close" FROM bars
        QUALIFY date >= max(date) OVER (PARTITION BY symbol) - 1825""",
    "sma": bounded([f"SMA_{n}" for n in (5, 10, 20, 50, 100, 200)]),
    "price_vs_sma": bounded([f"Price_vs_SMA{n}" for n in (5, 20, 50, 200)]),
    "golden_cross": bounded(["GoldenCross"]),
    "rsi": bounded(["RSI_14", "RSI_7"]),
    "stochastic": bounded(["Stoch_K", "Stoch_D"]),
    "williams_r": bounded(["Williams_R"]),
    "cci": bounded(["CCI"]),
    "roc": bounded(["ROC_1", "ROC_5", "ROC_10", "ROC_20"]),
    "bollinger": bounded(["BB_Upper", "BB_Mid", "BB_Lower", "BB_Width", "BB_Pct"]),
    "atr": bounded(["ATR_14", "ATR_Norm"]),
    "hist_vol": bounded(["HV_21"]),
    "hist_vol_full": f"""WITH {LAYERS} SELECT symbol, date, round(HVF_5, 6) AS HV_5,
        round(HVF_21, 6) AS HV_21 FROM l3""",
    "rolling_vol_log": bounded(["Vol_Log_30"]),
    "rolling_vol_simple": bounded(["Vol_Simple_30"]),
    "obv": bounded(["OBV"]),
    "volume_ratio": bounded(["Volume_SMA20", "Volume_Ratio"]),
    "price_action": bounded(["HL_Range", "OC_Range", "Upper_Shadow", "Lower_Shadow"]),
    "daily_return": bounded(["Daily_Return"]),
    "lags": bounded([f"Close_Lag{n}" for n in (1, 2, 3, 5, 10, 20)]),
    "lags_of_volume": f"""WITH {BARS} SELECT symbol, date, lag(volume, 1) OVER ({W}) AS Volume_Lag1,
        lag(volume, 7) OVER ({W}) AS Volume_Lag7 FROM bars""",
    "ma_full_window": f"""WITH {BARS} SELECT symbol, date,
        round({full("avg", '"close"', 5)}, 4) AS MA5,
        round({full("avg", '"close"', 20)}, 4) AS MA20 FROM bars""",
    "target": f"""WITH {BARS} SELECT symbol, date, lead("close", 1) OVER ({W}) AS Target_1,
        lead("close", 5) OVER ({W}) AS Target_5, lead("close", 21) OVER ({W}) AS Target_21 FROM bars""",
    "direction_flags": f"""WITH {LAYERS} SELECT symbol, date,
        CASE WHEN "close" >= open THEN 'up' ELSE 'down' END AS Body_Direction,
        CASE WHEN coalesce(Daily_Return, 0) >= 0 THEN 'up' ELSE 'down' END AS Change_Direction FROM l3""",
    "signals": f"""WITH {LAYERS} SELECT symbol, date,
        CASE WHEN RSI_14 > 70 THEN 'overbought' WHEN RSI_14 < 30 THEN 'oversold'
             WHEN RSI_14 IS NOT NULL THEN 'neutral' END AS RSI_Signal,
        CASE WHEN Stoch_K > 80 THEN 'overbought' WHEN Stoch_K < 20 THEN 'oversold'
             ELSE 'neutral' END AS Stoch_Signal,
        CASE WHEN Williams_R > -20 THEN 'overbought' WHEN Williams_R < -80 THEN 'oversold'
             ELSE 'neutral' END AS Williams_Signal,
        CASE WHEN CCI > 100 THEN 'overbought' WHEN CCI < -100 THEN 'oversold'
             ELSE 'neutral' END AS CCI_Signal FROM l3""",
    "ema": f"WITH RECURSIVE {BARS}, {EMA} SELECT symbol, date, "
    + pick([f"EMA_{n}" for n in (5, 10, 20, 50, 100, 200)])
    + " FROM means JOIN numbered USING (symbol, rn)",
    "ema_chart": f"WITH RECURSIVE {BARS}, {EMA} SELECT symbol, date, "
    + pick(["EMA_12", "EMA_26"])
    + " FROM means JOIN numbered USING (symbol, rn)",
    "macd": f"WITH RECURSIVE {BARS}, {EMA} SELECT symbol, date, "
    + pick(["MACD", "MACD_Signal", "MACD_Hist"])
    + ", CASE WHEN round(MACD_Hist, 2) >= 0 THEN 'positive' ELSE 'negative' END AS Hist_Sign"
    + " FROM means JOIN numbered USING (symbol, rn)",
    "calendar": bounded(
        ["DayOfWeek", "Month", "Quarter", "DayOfYear", "DOW_sin", "DOW_cos", "Month_sin", "Month_cos",
         "WeekOfYear"]
    ),
    "indicators": f"{ALL_ROWS} SELECT symbol, date, {pick(INDICATORS)} FROM wide",
    "context_join": f"""WITH {BARS}, {CONTEXT} SELECT symbol, date, {pick(["VIX", "SP500_Return"])}
        FROM with_context""",
    "context_empty": f"""WITH {BARS} SELECT symbol, date, 20.0::DOUBLE AS VIX, 0.0::DOUBLE AS SP500_Return
        FROM bars""",
    "context_vix": f"""WITH {BARS}, {CONTEXT} SELECT date, round(v, 2) AS VIX FROM ctx
        WHERE series = 'VIX'""",
    "context_sp500": f"""WITH {BARS}, {CONTEXT}, s AS (SELECT date, round(v, 2) AS SP500 FROM ctx
        WHERE series = 'SP500') SELECT date, SP500, round(SP500_Return, 6) AS SP500_Return
        FROM s JOIN sp USING (date)""",
    "forward_fill": f"""WITH {BARS}, gaps AS (SELECT symbol, date,
        CASE WHEN volume > 25 THEN volume END AS volume, CASE WHEN high > low THEN "close" END AS c
        FROM bars) SELECT symbol, date,
        last_value(volume IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS volume,
        last_value(c IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS "close" FROM gaps""",
    "features": f"""{ALL_ROWS} SELECT symbol, date, {pick(FEATURES)}, next1 AS Target FROM wide
        WHERE ROC_20 IS NOT NULL AND next1 IS NOT NULL""",
    "features_week": f"""{ALL_ROWS} SELECT symbol, date, {pick(["RSI_14", "EMA_20", "Close_Lag20"])},
        next5 AS Target FROM wide WHERE ROC_20 IS NOT NULL AND next5 IS NOT NULL""",
    "features_context": f"""{ALL_ROWS} SELECT symbol, date, {pick(FEATURES + ["VIX", "SP500_Return"])},
        next21 AS Target FROM wide
        WHERE ROC_20 IS NOT NULL AND next21 IS NOT NULL AND VIX IS NOT NULL""",
    "feature_counts": f"""WITH {BARS}, {CONTEXT},
        c AS (SELECT symbol, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n,
          VIX FROM with_context)
        SELECT symbol, count(*) AS bars, count(*) FILTER (rn > 20 AND rn <= n - 1) AS feature_rows,
          count(*) FILTER (rn > 20 AND rn <= n - 1 AND VIX IS NOT NULL) AS context_rows,
          61 AS features, 63 AS context_features FROM c GROUP BY symbol""",
}
