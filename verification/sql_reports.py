"""SQL for reports, evaluation, importances and regimes."""

from __future__ import annotations

from tidemark.fixed import NORMAL_CENTRE, NORMAL_FAR, NORMAL_TAIL
from verification.sql_bars import ALL_ROWS, BARS, CONTEXT, FEATURES, LAYERS, W

COLUMNS = ["open", "high", "low", "close", "volume"]
RETURNS = f"""{BARS},
rets AS (
  SELECT symbol, date, "close", ("close" / nullif(lag("close") OVER ({W}), 0) - 1) * 100 AS ret_pct
  FROM bars),
ret AS (SELECT * FROM rets WHERE ret_pct IS NOT NULL)"""

GAPPY = f"""{BARS},
gappy AS (SELECT symbol, date, open, high, low, CASE WHEN high > low THEN "close" END AS "close",
  CASE WHEN volume > 25 THEN volume END AS volume FROM bars)"""

FACTS = f"""
totals AS (
  SELECT l_returnflag AS flag, l_linestatus AS status, sum(floor(l_extendedprice * 100)) AS cents,
    sum(floor(l_quantity)) AS units, max(floor(l_extendedprice * 100)) AS top,
    min(floor(l_extendedprice * 100)) AS bottom
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
raw_facts AS (
  SELECT flag || status AS symbol,
    CASE WHEN flag = 'A' THEN 'Company ' || flag || status END AS longName,
    CASE WHEN status = 'O' THEN 'Open orders' END AS sector,
    CASE WHEN status = 'O' THEN 'Lines ' || flag END AS industry,
    CASE WHEN status = 'O' THEN 'buy' END AS recommendationKey,
    cents AS marketCap,
    CASE WHEN status = 'O' THEN top / units END AS trailingPE,
    top / bottom AS forwardPE,
    CASE WHEN flag = 'N' THEN 0.0 ELSE cents / (units * 100) / 1000 END AS priceToBook,
    CASE WHEN status = 'O' THEN bottom / top END AS dividendYield,
    CASE WHEN status = 'O' THEN cents / (units * 100) / 500 ELSE 1.0 END AS beta,
    top / 100 AS fiftyTwoWeekHigh, bottom / 100 AS fiftyTwoWeekLow,
    CASE WHEN status = 'O' THEN units END AS averageVolume,
    cents / (units * 100) AS currentPrice,
    CASE WHEN status = 'O' THEN cents / (units * 100) * 1.25 END AS targetMeanPrice,
    cents / (units * 100) AS trailingEps
  FROM totals),
facts AS (
  SELECT s.symbol, coalesce(longName, s.symbol) AS longName, coalesce(sector, 'N/A') AS sector,
    coalesce(industry, 'N/A') AS industry, coalesce(recommendationKey, 'N/A') AS recommendationKey,
    marketCap, trailingPE, forwardPE, priceToBook, dividendYield, beta, fiftyTwoWeekHigh,
    fiftyTwoWeekLow, averageVolume, currentPrice, targetMeanPrice,
    CAST(NULL AS DOUBLE) AS shortRatio, trailingEps, CAST(NULL AS DOUBLE) AS revenueGrowth
  FROM (SELECT DISTINCT l_returnflag || l_linestatus AS symbol FROM lineitem) s
  LEFT JOIN raw_facts f ON f.symbol = s.symbol)"""

CAP = """CASE WHEN marketCap IS NULL THEN 'N/A'
  WHEN marketCap >= 1e12 THEN printf('$%.2fT', marketCap / 1e12)
  WHEN marketCap >= 1e9 THEN printf('$%.2fB', marketCap / 1e9)
  WHEN marketCap >= 1e6 THEN printf('$%.2fM', marketCap / 1e6)
  ELSE '$' || format('{:,}', CAST(round_even(marketCap, 0) AS BIGINT)) END"""


def two(x: str, prefix: str = "") -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN 'N/A' ELSE printf('{prefix}%.2f', {x}) END"


def dollars(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', {x})"


LAST = f"""{BARS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars),
figures AS (
  SELECT symbol, max(date) FILTER (back = 1) AS last_date, max("close") FILTER (back = 1) AS "close",
    coalesce(max("close") FILTER (back = 2), max("close") FILTER (back = 1)) AS prev_close,
    max(volume) FILTER (back = 1) AS volume, max(high) AS high_52w, min(low) AS low_52w
  FROM ranked WHERE back <= 252 GROUP BY symbol),
kpi AS (SELECT *, ("close" - prev_close) / prev_close * 100 AS change_pct FROM figures)"""

# Evaluation on two deterministic predictors: the close itself and its five-row mean.
SPLIT = f"""{LAYERS},
base AS (
  SELECT symbol, date, "close", SMA_5, lead("close", 1) OVER ({W}) AS y, rn, n FROM l3),
rows_ AS (
  SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m
  FROM base WHERE rn > 20 AND y IS NOT NULL),
sized AS (SELECT *, CAST(floor(m * 0.8) AS BIGINT) AS tr FROM rows_),
sized2 AS (SELECT *, tr // 6 AS s FROM sized),
seg AS (
  SELECT symbol, date, "close", SMA_5, y,
    CASE WHEN i < tr THEN 'train' ELSE 'test' END AS split,
    CASE WHEN i >= tr THEN 6 WHEN i < tr - 5 * s THEN 0
         ELSE CAST((i - (tr - 5 * s)) // s + 1 AS INTEGER) END AS segment
  FROM sized2),
pred AS (
  SELECT symbol, date, split, segment, y, 'last close' AS model, "close" AS yhat FROM seg
  UNION ALL
  SELECT symbol, date, split, segment, y, 'mean of five' AS model, SMA_5 AS yhat FROM seg),
tested AS (
  SELECT *, sign(y - lag(y) OVER v) = sign(yhat - lag(yhat) OVER v) AS same FROM pred
  WHERE split = 'test' WINDOW v AS (PARTITION BY symbol, model ORDER BY date)),
measured AS (
  SELECT symbol, model, sqrt(avg((y - yhat) ** 2)) AS RMSE, avg(abs(y - yhat)) AS MAE,
    1 - sum((y - yhat) ** 2) / nullif(var_pop(y) * count(*), 0) AS R2,
    avg(abs((y - yhat) / (y + 1e-8))) * 100 AS MAPE,
    avg(CAST(same AS INTEGER)) * 100 AS Direction_Acc
  FROM tested GROUP BY symbol, model),
scores AS (
  SELECT symbol, model, segment - 1 AS fold,
    1 - sum((y - yhat) ** 2) / nullif(var_pop(y) * count(*), 0) AS r2
  FROM pred WHERE segment BETWEEN 1 AND 5 GROUP BY ALL),
sigmas AS (SELECT symbol, model, stddev_pop(y - yhat) AS sigma FROM tested GROUP BY ALL)"""

# Importances: absolute correlation with the label, of two "models" (levels and changes).
CORR = f"""{ALL_ROWS},
ready AS (SELECT *, next1 AS y FROM wide WHERE ROC_20 IS NOT NULL AND next1 IS NOT NULL),
corr_wide AS (
  SELECT symbol, {", ".join(f'abs(corr("{c}", y)) AS "{c}"' for c in FEATURES)} FROM ready GROUP BY symbol),
corr_long AS (UNPIVOT corr_wide ON {", ".join(f'"{c}"' for c in FEATURES)} INTO NAME feature VALUE v),
change_wide AS (
  SELECT symbol, {", ".join(f'abs(corr("{c}", y - "close")) AS "{c}"' for c in FEATURES)}
  FROM ready GROUP BY symbol),
change_long AS (UNPIVOT change_wide ON {", ".join(f'"{c}"' for c in FEATURES)} INTO NAME feature VALUE v),
imp AS (
  SELECT symbol, 'level' AS model, feature, round(v, 6) AS importance FROM corr_long
  UNION ALL SELECT symbol, 'change', feature, round(v, 6) FROM change_long)"""



def _quotient(parts, x):
    """SQL of a quotient of polynomials, coefficients lowest power first."""
    top, bottom = ("+".join(f"{c!r}::DOUBLE*pow({x},{i})" for i, c in enumerate(part)) for part in parts)
    return f"(({top})/({bottom}))"


QQ = f"""{RETURNS},
placed AS (
  SELECT symbol, ret_pct AS x, row_number() OVER (PARTITION BY symbol ORDER BY ret_pct, date) AS rank,
    count(*) OVER (PARTITION BY symbol) AS n FROM ret),
shares AS (
  SELECT *, CASE WHEN rank = n THEN pow(0.5::DOUBLE, 1 / n::DOUBLE) WHEN rank = 1 THEN 1 - pow(0.5::DOUBLE, 1 / n::DOUBLE)
    ELSE (rank - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM placed),
tails AS (SELECT *, sqrt(-ln(least(p, 1 - p))) AS t FROM shares),
qq AS (
  SELECT symbol, rank, x, p, CASE
    WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_quotient(NORMAL_CENTRE, "(0.180625 - (p - 0.5) * (p - 0.5))")}
    WHEN t <= 5 THEN sign(p - 0.5) * {_quotient(NORMAL_TAIL, "(t - 1.6)")}
    ELSE sign(p - 0.5) * {_quotient(NORMAL_FAR, "(t - 5)")} END AS z FROM tails)"""

PATTERNS = """
patterns(feature_group, part) AS (VALUES
  ('Moving Averages', 'SMA_'), ('Moving Averages', 'EMA_'), ('Moving Averages', 'Price_vs'),
  ('Moving Averages', 'GoldenCross'), ('Momentum', 'RSI'), ('Momentum', 'MACD'),
  ('Momentum', 'Stoch'), ('Momentum', 'Williams'), ('Momentum', 'CCI'), ('Momentum', 'ROC'),
  ('Volatility', 'BB_'), ('Volatility', 'ATR'), ('Volatility', 'HV'), ('Volume', 'OBV'),
  ('Volume', 'Volume'), ('Price Action', 'HL_Range'), ('Price Action', 'OC_Range'),
  ('Price Action', 'Shadow'), ('Price Action', 'Daily_Return'), ('Lag Features', '_Lag'),
  ('Time Features', 'DOW'), ('Time Features', 'Month'), ('Time Features', 'Quarter'),
  ('Time Features', 'Week'), ('Time Features', 'DayOf'), ('Market Context', 'VIX'),
  ('Market Context', 'SP500'))"""

IMPORTANT = """
placed AS (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY importance DESC, feature)
  AS place FROM imp)"""

REGIME = f"""{LAYERS}, {CONTEXT},
days AS (
  SELECT l3.symbol, l3.date, l3."close", Daily_Return * 100 AS Daily_Return, HVF_5 AS HV_5,
    HVF_21 AS HV_21, Volume_Ratio, RSI_14, BB_Pct, c.VIX, c.SP500_Return * 100 AS SP500_Return
  FROM l3 JOIN with_context c USING (symbol, date)),
full_days AS (
  SELECT * FROM days WHERE Daily_Return IS NOT NULL AND HV_5 IS NOT NULL AND HV_21 IS NOT NULL
    AND BB_Pct IS NOT NULL AND RSI_14 IS NOT NULL AND Volume_Ratio IS NOT NULL)"""

# A fixed rule instead of K-means, so that SQL can follow everything after the labels.
RULED = f"""{REGIME},
ruled AS (
  SELECT *, CASE WHEN RSI_14 >= 60 THEN 10 WHEN BB_Pct < 0.3 THEN 20 ELSE 30 END AS cluster
  FROM full_days),
ranks AS (
  SELECT symbol, cluster,
    row_number() OVER (PARTITION BY symbol ORDER BY avg(Daily_Return) DESC, cluster) - 1 AS regime
  FROM ruled GROUP BY symbol, cluster),
labelled AS (SELECT ruled.*, CAST(ranks.regime AS INTEGER) AS regime FROM ruled JOIN ranks
  USING (symbol, cluster))"""

_SCALE = ["Daily_Return", "HV_5", "HV_21", "Volume_Ratio", "RSI_14", "BB_Pct"]
SILHOUETTE = f"""{RULED},
scaled AS (
  SELECT symbol, date, regime, {", ".join(
    f"({c} - avg({c}) OVER s) / stddev_pop({c}) OVER s AS z{i}" for i, c in enumerate(_SCALE))}
  FROM labelled WINDOW s AS (PARTITION BY symbol)),
to_cluster AS (
  SELECT a.symbol, a.date, a.regime AS own, b.regime AS other, count(*) AS n,
    sum(sqrt({" + ".join(f"(a.z{i} - b.z{i}) ** 2" for i in range(6))})) AS total
  FROM scaled a JOIN scaled b ON a.symbol = b.symbol GROUP BY ALL),
ab AS (
  SELECT symbol, date, max(CASE WHEN own = other THEN total / (n - 1) END) AS a,
    min(CASE WHEN own <> other THEN total / n END) AS b FROM to_cluster GROUP BY symbol, date)"""

SQL = {
    "universe_filter": f"""WITH {BARS} SELECT symbol, count(*) AS n FROM bars
        WHERE symbol IN (SELECT l_returnflag || l_linestatus FROM lineitem WHERE l_linestatus = 'O')
        GROUP BY symbol""",
    "wide_to_long": f'WITH {BARS} SELECT symbol, date, open, high, low, "close", volume FROM bars',
    "snapshot": f"""WITH {LAYERS}, s AS (SELECT symbol, date, open, high, low, "close", volume,
        avg("close") OVER ({W} ROWS 4 PRECEDING) AS m5, SMA_20 AS m20, rn, n,
        lead("close") OVER ({W}) AS Target FROM l3)
        SELECT symbol, date, open, high, low, "close", volume, round(m5, 4) AS MA5,
          round(m20, 4) AS MA20, Target FROM s WHERE rn >= 20 AND Target IS NOT NULL""",
    "company_facts": f"""WITH {FACTS} SELECT symbol, longName, sector, industry, recommendationKey,
        marketCap, round(trailingPE, 6) AS trailingPE, round(forwardPE, 6) AS forwardPE,
        round(priceToBook, 6) AS priceToBook, round(dividendYield, 6) AS dividendYield,
        round(beta, 6) AS beta, shortRatio, revenueGrowth FROM facts""",
    "fact_sheet": f"""WITH {FACTS} SELECT symbol, longName, sector, industry, {CAP} AS market_cap,
        {two("trailingPE")} AS trailing_pe, {two("forwardPE")} AS forward_pe,
        {two("priceToBook")} AS price_to_book, {two("trailingEps", "$")} AS eps,
        CASE WHEN dividendYield IS NULL THEN 'N/A' ELSE printf('%.2f%%', dividendYield * 100) END
          AS dividend_yield,
        {two("beta")} AS beta_text, coalesce(beta > 1.5, false) AS beta_flag,
        coalesce('$' || CAST(fiftyTwoWeekHigh AS VARCHAR), '$N/A') AS high_52w,
        coalesce('$' || CAST(fiftyTwoWeekLow AS VARCHAR), '$N/A') AS low_52w,
        {two("targetMeanPrice", "$")} AS target_price, upper(recommendationKey) AS analyst_rating
        FROM facts""",
    "market_cap_text": f"""WITH {BARS}, x AS (SELECT symbol, date, "close" * volume AS marketCap FROM bars)
        SELECT symbol, date, {CAP} AS market_cap,
          printf('%.2f%%', marketCap / 1e9 * 100) AS share FROM x""",
    "profile": f"""WITH {BARS} SELECT symbol, min(date) AS first_date, max(date) AS last_date,
        count(*) AS n_bars, 5 AS n_columns FROM bars GROUP BY symbol""",
    "column_types": f"""WITH {BARS}, n AS (SELECT count(*) AS n_rows FROM bars)
        SELECT position, "column", "type", n_rows FROM n, (VALUES (0, 'symbol', 'string'), (1, 'date', 'date'),
          (2, 'open', 'double'), (3, 'high', 'double'), (4, 'low', 'double'), (5, 'close', 'double'),
          (6, 'volume', 'double')) v(position, "column", "type")""",
    "missing": f"""WITH {GAPPY}, w AS (SELECT symbol, {", ".join(
        f'count(*) - count("{c}") AS "{c}"' for c in COLUMNS)} FROM gappy GROUP BY symbol)
        SELECT symbol, "column", missing FROM (UNPIVOT w ON {", ".join(f'"{c}"' for c in COLUMNS)}
          INTO NAME "column" VALUE missing)""",
    "completeness": f"""WITH {GAPPY} SELECT symbol, round((1 - ({" + ".join(
        f'count(*) - count("{c}")' for c in COLUMNS)}) / (count(*) * 5)) * 100, 6) AS completeness
        FROM gappy GROUP BY symbol""",
    "complete_rows": f"""WITH {GAPPY} SELECT symbol, count(*) AS bars,
        count(*) FILTER ("close" IS NOT NULL AND volume IS NOT NULL) AS complete,
        count(*) FILTER ("close" IS NOT NULL OR volume IS NOT NULL) AS not_empty
        FROM gappy GROUP BY symbol""",
    "minimum_rows": f"""WITH {BARS}, b AS (SELECT *, count(*) OVER (PARTITION BY symbol, year(date)) AS n
        FROM bars) SELECT symbol || year(date) AS symbol, count(*) AS n_bars FROM b WHERE n >= 355
        GROUP BY ALL""",
    "head": f"""WITH {BARS} SELECT symbol, date, open, high, low, "close", volume FROM bars
        QUALIFY row_number() OVER ({W}) <= 5""",
    "describe": f"""WITH {BARS}, l AS (UNPIVOT bars ON open, high, low, "close", volume
          INTO NAME "column" VALUE v)
        SELECT symbol, "column", count(v) AS count, round(avg(v), 4) AS mean,
          round(stddev_samp(v), 2) AS std, min(v) AS min, quantile_cont(v, 0.25) AS q25,
          quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max
        FROM l GROUP BY ALL""",
    "return_moments": f"""WITH {RETURNS}, m AS (SELECT symbol, avg(ret_pct) AS mean,
          stddev_samp(ret_pct) AS std, skewness(ret_pct) AS skewness, kurtosis(ret_pct) AS kurtosis
        FROM ret GROUP BY symbol)
        SELECT symbol, round(mean, 6) AS mean, round(std, 6) AS std, round(skewness, 6) AS skewness,
          round(kurtosis, 6) AS kurtosis,
          CASE WHEN skewness > 0 THEN 'Right-skewed' ELSE 'Left-skewed' END AS skew_label,
          CASE WHEN kurtosis > 3 THEN 'Fat tails' ELSE 'Normal tails' END AS tail_label,
          CASE WHEN abs(skewness) < 0.5 THEN 'Approximately normal' ELSE 'Deviates from normal' END
            AS shape_label FROM m""",
    **{
        name: f"""WITH {RETURNS}, lim AS (SELECT symbol, min(ret_pct) AS lo,
            (max(ret_pct) - min(ret_pct)) / {bins} AS width, avg(ret_pct) AS mean FROM ret GROUP BY symbol),
          c AS (SELECT symbol, least(CAST(floor((ret_pct - lo) / width) AS BIGINT), {bins - 1}) AS bin,
            count(*) AS n FROM ret JOIN lim USING (symbol) GROUP BY ALL),
          g AS (SELECT symbol, lo, width, mean, unnest(range({bins})) AS bin FROM lim)
          SELECT symbol, bin, round(lo + bin * width, 6) AS low_edge, coalesce(n, 0) AS count,
            round(mean, 6) AS mean FROM g LEFT JOIN c USING (symbol, bin)"""
        for name, bins in (("histogram", 50), ("histogram_fine", 80))
    },
    "return_ranks": f"""WITH {RETURNS} SELECT symbol, date, row_number() OVER
        (PARTITION BY symbol ORDER BY ret_pct, date) AS rank, count(*) OVER (PARTITION BY symbol)
        AS n_ranked FROM ret""",
    "corr_topk": f"""{CORR}, r AS (SELECT symbol, feature, v, row_number() OVER
          (PARTITION BY symbol ORDER BY round(v, 9) DESC NULLS LAST, feature) AS place FROM corr_long)
        SELECT symbol, CAST(place AS INTEGER) AS rank, feature, round(v, 6) AS abs_corr FROM r WHERE place <= 30""",
    "qq": f"""WITH {QQ} SELECT symbol, rank, round(x, 6) AS ordered, round(p, 9) AS position,
        round(z, 6) AS theoretical FROM qq""",
    "qq_line": f"""WITH {QQ} SELECT symbol, round(regr_slope(x, z), 6) AS slope,
        round(regr_intercept(x, z), 6) AS intercept, round(corr(x, z), 6) AS r FROM qq GROUP BY symbol""",
    "correlations": f"""{CORR} SELECT symbol, feature, round(v, 6) AS abs_corr FROM corr_long""",
    "monthly_seasonality": f"""WITH {RETURNS}, m AS (SELECT symbol, year(date) AS year,
          month(date) AS month, avg(ret_pct) AS r FROM ret GROUP BY ALL)
        SELECT symbol, CAST(year AS INTEGER) AS year, {", ".join(
            f"round(max(r) FILTER (month = {i}), 6) AS {n}" for i, n in enumerate(
                "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1))}
        FROM m GROUP BY symbol, year""",
    "dow_seasonality": f"""WITH {RETURNS} SELECT symbol, CAST(isodow(date) - 1 AS INTEGER) AS weekday,
        round(avg(ret_pct), 6) AS mean_return, strftime(min(date), '%a') AS weekday_name
        FROM ret GROUP BY symbol, isodow(date)""",
    "dow_effect": f"""WITH {RETURNS}, d AS (SELECT symbol, strftime(min(date), '%a') AS day,
          avg(ret_pct) AS r FROM ret GROUP BY symbol, isodow(date))
        SELECT symbol, arg_max(day, r) AS best_day, round(max(r), 6) AS best_return,
          arg_min(day, r) AS worst_day, round(min(r), 6) AS worst_return,
          CASE WHEN max(r) - min(r) > 0.1 THEN 'Detected' ELSE 'Minimal' END AS effect
        FROM d GROUP BY symbol""",
    "annual_return": f"""WITH {BARS}, y AS (SELECT symbol, year(date) AS year,
          arg_min("close", date) AS a, arg_max("close", date) AS b FROM bars GROUP BY ALL)
        SELECT symbol, CAST(year AS INTEGER) AS year, round((b - a) / a * 100, 6) AS annual_return,
          CASE WHEN (b - a) / a >= 0 THEN 'positive' ELSE 'negative' END AS sign FROM y""",
    "year_range": f"""WITH {LAST} SELECT symbol, max(high) AS high_52w, min(low) AS low_52w FROM ranked
        WHERE back <= 252 GROUP BY symbol""",
    "last_rows": f"""WITH {LAST} SELECT symbol, date, "close", back AS from_end FROM ranked
        WHERE back <= 252""",
    "kpi": f"""WITH {LAST} SELECT symbol, last_date, "close", prev_close, volume, high_52w, low_52w,
        round(change_pct, 6) AS change_pct,
        CASE WHEN change_pct >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM kpi""",
    "kpi_text": f"""WITH {LAST}, {FACTS} SELECT k.symbol,
        CASE WHEN change_pct >= 0 THEN 'positive' ELSE 'negative' END AS direction,
        {dollars('"close"')} AS current_price,
        (CASE WHEN change_pct >= 0 THEN '▲' ELSE '▼' END) || printf(' %.2f%%', abs(change_pct))
          AS price_note,
        printf('%+.2f%%', change_pct) AS one_day_change,
        'vs prev close ' || {dollars("prev_close")} AS change_note,
        {dollars("high_52w")} AS high_52w_text, {dollars("low_52w")} AS low_52w_text,
        format('{{:,}}', CAST(volume AS BIGINT)) AS volume_text, {CAP} AS market_cap,
        coalesce(CAST(round(trailingPE, 3) AS VARCHAR), 'N/A') AS pe_ratio
        FROM kpi k JOIN facts USING (symbol)""",
    "business_days": f"""WITH {BARS}, s AS (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol),
        d AS (SELECT symbol, CAST(unnest(generate_series(last_date + 1, last_date + 67, INTERVAL 1 DAY))
          AS DATE) AS date FROM s)
        SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) AS INTEGER) AS step, date FROM d
        WHERE isodow(date) <= 5 QUALIFY step <= 30""",
    "time_split": f"""WITH {SPLIT} SELECT symbol, split, count(*) AS n, min(date) AS first, max(date) AS last
        FROM seg GROUP BY ALL""",
    "cv_folds": f"""WITH {SPLIT}, f AS (SELECT symbol, CAST(unnest(range(5)) AS INTEGER) AS fold, segment, date FROM seg)
        SELECT symbol, fold, CASE WHEN segment <= fold THEN 'train' ELSE 'valid' END AS role,
          count(*) AS n, min(date) AS first, max(date) AS last FROM f WHERE segment <= fold + 1
        GROUP BY ALL""",
    "metrics": f"""WITH {SPLIT} SELECT symbol, model, round(RMSE, 2) AS RMSE, round(MAE, 2) AS MAE,
        round(R2, 6) AS R2, round(MAPE, 6) AS MAPE, round(Direction_Acc, 6) AS Direction_Acc
        FROM measured""",
    "metrics_long": f"""WITH {SPLIT}, m AS (SELECT symbol, model, RMSE, MAE, R2, MAPE, Direction_Acc
          FROM measured)
        SELECT symbol, model, metric, round("value", 4) AS "value" FROM (UNPIVOT m ON RMSE, MAE, R2, MAPE,
          Direction_Acc INTO NAME metric VALUE "value")""",
    "cv_scores": f"WITH {SPLIT} SELECT symbol, model, fold, round(r2, 6) AS r2 FROM scores",
    "cv_summary": f"""WITH {SPLIT}, c AS (SELECT symbol, model, avg(r2) AS m, stddev_pop(r2) AS s
          FROM scores GROUP BY ALL)
        SELECT symbol, model, round(RMSE, 4) AS RMSE, round(MAE, 4) AS MAE, round(R2, 4) AS R2,
          round(MAPE, 4) AS MAPE, round(Direction_Acc, 4) AS Direction_Acc,
          round(m, 4) AS CV_R2_Mean, round(s, 4) AS CV_R2_Std FROM measured JOIN c USING (symbol, model)""",
    "cv_distribution": f"""WITH {SPLIT} SELECT symbol, model, round(min(r2), 6) AS low,
        round(quantile_cont(r2, 0.25), 6) AS q25, round(quantile_cont(r2, 0.5), 6) AS median,
        round(quantile_cont(r2, 0.75), 6) AS q75, round(max(r2), 6) AS high FROM scores GROUP BY ALL""",
    "best_model": f"""WITH {SPLIT} SELECT symbol, arg_min(model, RMSE) AS model, round(min(RMSE), 2) AS RMSE
        FROM measured GROUP BY symbol""",
    "best_predictions": f"""WITH {SPLIT}, b AS (SELECT symbol, arg_min(model, RMSE) AS model FROM measured
          GROUP BY symbol)
        SELECT symbol, date, model, y, round(yhat, 4) AS yhat FROM tested JOIN b USING (symbol, model)""",
    "direction_pairs": f"""WITH {SPLIT} SELECT symbol, model, count(*) AS n, count(same) AS pairs,
        count(*) FILTER (same) AS hits FROM tested GROUP BY ALL""",
    "residuals": f"""WITH {SPLIT} SELECT symbol, date, model, round(y - yhat, 4) AS residual,
        CASE WHEN y - yhat >= 0 THEN 'positive' ELSE 'negative' END AS sign, round(sigma, 2) AS sigma,
        round(yhat - sigma, 2) AS lower, round(yhat + sigma, 2) AS upper
        FROM tested JOIN sigmas USING (symbol, model)""",
    "scatter_limits": f"""WITH {SPLIT} SELECT symbol, model, round(least(min(y), min(yhat)), 4) AS low,
        round(greatest(max(y), max(yhat)), 4) AS high, count(*) AS n FROM tested GROUP BY ALL""",
    "first_test_rows": f"""WITH {SPLIT} SELECT symbol, date, "close", y FROM seg WHERE split = 'test'
        QUALIFY row_number() OVER ({W}) <= 100""",
    "timeline": f"""WITH {SPLIT},
        fc AS (SELECT s.symbol, s.model, CAST(d AS DATE) AS date, s.yhat,
          s.yhat - 1.5 * g.sigma AS lower, s.yhat + 1.5 * g.sigma AS upper
          FROM (SELECT symbol, model, arg_max(yhat, date) AS yhat, max(date) AS last_date FROM tested
            GROUP BY ALL) s JOIN sigmas g USING (symbol, model),
          LATERAL (SELECT unnest(generate_series(last_date + 1, last_date + 21, INTERVAL 1 DAY)) AS d) x
          WHERE isodow(d) <= 5
          QUALIFY row_number() OVER (PARTITION BY s.symbol, s.model ORDER BY d) <= 7)
        SELECT symbol, date, model, 'train' AS segment, y, round(yhat, 2) AS yhat,
          CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM pred WHERE split = 'train'
        UNION ALL SELECT symbol, date, model, 'test', y, round(yhat, 2), round(yhat - sigma, 2),
          round(yhat + sigma, 2) FROM tested JOIN sigmas USING (symbol, model)
        UNION ALL SELECT symbol, date, model, 'forecast', CAST(NULL AS DOUBLE), round(yhat, 2),
          round(lower, 2), round(upper, 2) FROM fc""",
    "importance_top": f"""{CORR}, {IMPORTANT} SELECT symbol, model, feature, importance, CAST(place AS INTEGER) AS rank
        FROM placed WHERE place <= 20""",
    "importance_relative": f"""{CORR} SELECT symbol, model, feature, round(importance /
        max(importance) OVER (PARTITION BY symbol, model) * 100, 4) AS relative FROM imp""",
    "importance_groups": f"""{CORR}, {PATTERNS},
        m AS (SELECT DISTINCT symbol, model, feature, importance, feature_group FROM imp JOIN patterns
          ON contains(feature, part)),
        g AS (SELECT symbol, model, feature_group, sum(importance) AS total FROM m GROUP BY ALL)
        SELECT symbol, model, feature_group, round(coalesce(total, 0.0), 6) AS total
        FROM (SELECT DISTINCT symbol, model, feature_group FROM imp, patterns)
        LEFT JOIN g USING (symbol, model, feature_group)""",
    "importance_cumulative": f"""{CORR}, {IMPORTANT} SELECT symbol, model, feature, CAST(place AS INTEGER) AS rank,
        round(sum(importance) OVER (PARTITION BY symbol, model ORDER BY place ROWS UNBOUNDED PRECEDING)
          / sum(importance) OVER (PARTITION BY symbol, model) * 100, 4) AS cumulative FROM placed""",
    "importance_to_80": f"""{CORR}, {IMPORTANT}, c AS (SELECT symbol, model, sum(importance) OVER
          (PARTITION BY symbol, model ORDER BY place ROWS UNBOUNDED PRECEDING)
          / sum(importance) OVER (PARTITION BY symbol, model) * 100 AS cumulative FROM placed)
        SELECT symbol, model, count(*) FILTER (cumulative < 80) + 1 AS n_features FROM c GROUP BY ALL""",
    "model_comparison": f"""{CORR}, {IMPORTANT},
        u AS (SELECT symbol, feature, max(importance) AS best FROM placed WHERE place <= 10 GROUP BY ALL),
        t AS (SELECT symbol, feature FROM u QUALIFY row_number() OVER
          (PARTITION BY symbol ORDER BY best DESC, feature) <= 15)
        SELECT t.symbol, m.model, t.feature, coalesce(i.importance, 0.0) AS importance
        FROM t JOIN (SELECT DISTINCT symbol, model FROM imp) m ON m.symbol = t.symbol
        LEFT JOIN imp i ON i.symbol = t.symbol AND i.model = m.model AND i.feature = t.feature""",
    "regime_features": f"""WITH {REGIME} SELECT symbol, date, round(Daily_Return, 6) AS Daily_Return,
        round(HV_5, 6) AS HV_5, round(HV_21, 6) AS HV_21, round(Volume_Ratio, 6) AS Volume_Ratio,
        round(RSI_14, 6) AS RSI_14, round(BB_Pct, 6) AS BB_Pct, round(VIX, 2) AS VIX,
        round(SP500_Return, 6) AS SP500_Return FROM full_days WHERE VIX IS NOT NULL""",
    "regime_features_dashboard": f"""WITH {REGIME}, d AS (SELECT f.*,
        CASE WHEN count(*) OVER (PARTITION BY f.symbol ORDER BY f.date ROWS 19 PRECEDING) >= 20 THEN 1 END
          AS enough, CAST(1 AS INTEGER) AS one FROM days f)
        SELECT symbol, date, round(Daily_Return, 6) AS Daily_Return, round(HV_5, 6) AS HV_5,
          round(HV_21, 6) AS HV_21, round(Volume_Ratio, 6) AS Volume_Ratio, round(VIX, 2) AS VIX FROM d
        WHERE Daily_Return IS NOT NULL AND HV_21 IS NOT NULL AND HV_5 IS NOT NULL AND enough = 1
          AND VIX IS NOT NULL""",
    "regime_ruled": f"""WITH {RULED} SELECT symbol, date, "close", round(HV_21, 6) AS HV_21,
        round(Daily_Return, 6) AS Daily_Return, regime,
        CASE regime WHEN 0 THEN 'Bullish / Low-Vol' WHEN 1 THEN 'High-Vol / Uncertain'
          ELSE 'Bearish / Drawdown' END AS regime_label FROM labelled""",
    "regime_stats": f"""WITH {RULED} SELECT symbol, regime, count(*) AS days,
        round(count(*) / sum(count(*)) OVER (PARTITION BY symbol) * 100, 1) AS share_pct,
        round(avg(Daily_Return), 4) AS mean_return, round(avg(HV_21), 4) AS mean_hv21,
        round(avg(RSI_14), 2) AS mean_rsi, round(max(Daily_Return), 2) AS max_return,
        round(min(Daily_Return), 2) AS min_return FROM labelled GROUP BY symbol, regime""",
    "regime_means": f"""WITH {RULED} SELECT symbol, regime, round(avg(Daily_Return), 5) AS mean_return
        FROM labelled GROUP BY symbol, regime""",
    "regime_centres": f"""WITH {RULED} SELECT symbol, regime, {", ".join(
        f"round(avg({c}), 5) AS {c}" for c in _SCALE)} FROM labelled GROUP BY symbol, regime""",
    "silhouette": f"""WITH {SILHOUETTE} SELECT symbol, round(avg((b - a) / greatest(a, b)), 6) AS silhouette
        FROM ab GROUP BY symbol""",
}
