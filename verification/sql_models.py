"""SQL for queries of the model group that SQL can express."""

from __future__ import annotations

from verification.sql_bars import ALL_ROWS, BARS, CONTEXT, FEATURES, LAYERS, W
from verification.sql_reports import CORR, FACTS, RULED, SPLIT

MODELS = "(VALUES ('Linear Regression'), ('Ridge Regression'), ('Random Forest'), ('XGBoost'), ('Gradient Boosting')) AS m(model)"

# All features of the rows that models learn from, with their segment.
LEARN = f"""{ALL_ROWS},
ready AS (
  SELECT *, next1 AS y, row_number() OVER ({W}) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS places
  FROM wide WHERE ROC_20 IS NOT NULL AND next1 IS NOT NULL),
learn AS (
  SELECT *, CASE WHEN place < trained - 5 * part THEN 0
                 ELSE CAST((place - (trained - 5 * part)) // part + 1 AS INTEGER) END AS segment
  FROM (SELECT *, trained // 6 AS part FROM (SELECT *, CAST(floor(places * 0.8) AS BIGINT) AS trained FROM ready))
  WHERE place < trained)"""


def wide(x: str, digits: int = 5) -> str:
    pushed = f"({x}) * (1 + 1e-10::DOUBLE)"
    return f"CASE WHEN abs({pushed}) >= 1000 THEN round({pushed}, 0) ELSE round({pushed}, {digits}) END + 0.0"


NAMES = sorted(FEATURES)
SHAP = f"""{LEARN},
centres AS (SELECT symbol, {", ".join(f'avg(CAST("{c}" AS DOUBLE)) AS "m_{c}"' for c in NAMES)} FROM learn GROUP BY symbol),
tested_ AS (SELECT * FROM ready JOIN centres USING (symbol) WHERE place >= CAST(floor(places * 0.8) AS BIGINT)),
terms AS (SELECT symbol, date, {", ".join(f'{round((i + 1) * 0.0137 * (-1) ** i, 4)}::DOUBLE * ("{c}" - "m_{c}") AS "{c}"' for i, c in enumerate(NAMES))}
  FROM tested_),
values_ AS (SELECT symbol, date, {", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in NAMES)} FROM tested_),
shap AS (
  SELECT symbol, date, feature, shap, feature_value
  FROM (UNPIVOT terms ON {", ".join(f'"{c}"' for c in NAMES)} INTO NAME feature VALUE shap)
  JOIN (UNPIVOT values_ ON {", ".join(f'"{c}"' for c in NAMES)} INTO NAME feature VALUE feature_value)
  USING (symbol, date, feature))"""


def first_split(rate: str, l2: str) -> str:
    """Best first split over all cuts of all features, found with running sums."""
    casts = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in FEATURES)
    columns = ", ".join(f'"{c}"' for c in FEATURES)
    return f"""{LEARN},
centred AS (SELECT symbol, y, y - avg(y) OVER (PARTITION BY symbol) AS r, {casts} FROM learn),
long_ AS (UNPIVOT centred ON {columns} INTO NAME feature VALUE v),
valued AS (SELECT symbol, feature, v, sum(r) AS g, count(*) AS n, sum(y) AS t FROM long_ GROUP BY ALL),
running AS (
  SELECT symbol, feature, v, sum(g) OVER o AS gl, sum(n) OVER o AS nl, sum(t) OVER o AS tl,
    sum(g) OVER p AS g, sum(n) OVER p AS n, sum(t) OVER p AS t
  FROM valued WINDOW p AS (PARTITION BY symbol, feature), o AS (PARTITION BY symbol, feature ORDER BY v)),
best AS (
  SELECT * FROM running WHERE nl < n QUALIFY row_number() OVER (
    PARTITION BY symbol ORDER BY gl * gl / (nl + {l2}) + (g - gl) * (g - gl) / (n - nl + {l2}) DESC) = 1)
SELECT symbol, round(t / n + {rate} * gl / (nl + {l2}), 5) AS yhat, nl::BIGINT AS n, round(tl / nl, 5) AS mean_y FROM best
UNION ALL
SELECT symbol, round(t / n + {rate} * (g - gl) / (n - nl + {l2}), 5), (n - nl)::BIGINT, round((t - tl) / (n - nl), 5) FROM best"""


def forecast_given(state: str, places: list[int], moved: str) -> str:
    """Steps of a model with given weights of six values; `places`: where they stand in the state, newest first."""
    weights = (0.5501337, 0.2498713, 0.0502171, 0.0997931, 0.0201719, 0.0198311)
    value = " + ".join(f"{w!r}::DOUBLE * s[{k}]" for w, k in zip(weights, places))
    return f"""WITH RECURSIVE {BARS},
past AS (SELECT symbol, max(date) AS last_date, list("close" ORDER BY date DESC)[1:21] AS p FROM bars GROUP BY symbol),
steps AS (
  SELECT symbol, last_date, 0 AS step, {state} AS s, NULL::DOUBLE AS yhat FROM past
  UNION ALL
  SELECT symbol, last_date, step + 1, {moved}, v
  FROM (SELECT *, 10000.0::DOUBLE + {value} AS v FROM steps WHERE step < 30))
SELECT symbol, last_date, step, round(yhat, 3) AS yhat FROM steps WHERE step > 0"""


SQL = {
    "forecast_given": forecast_given("p", [2, 3, 4, 6, 11, 21], "list_prepend(v, s)[1:21]"),
    "forecast_given_week": forecast_given(
        "p", [2, 3, 4, 6, 11, 21], "([v, " + ", ".join(f"v + (s[1] - v) * ({i} / 5.0::DOUBLE)" for i in (1, 2, 3, 4)) + "] || s)[1:21]"
    ),
    "forecast_given_slots": forecast_given(
        "[p[2], p[3], p[4], p[6], p[11], p[21]]", [1, 2, 3, 4, 5, 6], "list_prepend(v, s)[1:6]"
    ),
    "first_split": first_split("1.0", "0.0"),
    "first_split_l2": first_split("0.05", "1.0"),
    # Normal equations of two scaled features: (n + alpha, n r; n r, n + alpha) w = (c1, c2).
    "linear_pair": f"""{LEARN},
        folds AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fold),
        moments AS (
          SELECT symbol, fold, count(*) AS n, avg(RSI_14) AS m1, avg(Volume_Ratio) AS m2, avg(y) AS my,
            stddev_pop(RSI_14) AS s1, stddev_pop(Volume_Ratio) AS s2, corr(RSI_14, Volume_Ratio) AS r,
            covar_pop(RSI_14, y) * count(*) / stddev_pop(RSI_14) AS c1,
            covar_pop(Volume_Ratio, y) * count(*) / stddev_pop(Volume_Ratio) AS c2
          FROM learn JOIN folds ON segment <= CASE fold WHEN -1 THEN 5 ELSE fold END GROUP BY ALL),
        solved AS (
          SELECT *, ((n + a) * c1 - n * r * c2) / ((n + a) * (n + a) - n * r * n * r) AS w1,
            ((n + a) * c2 - n * r * c1) / ((n + a) * (n + a) - n * r * n * r) AS w2
          FROM moments, (VALUES ('Linear Regression', 0.0), ('Ridge Regression', 1.0)) AS k(model, a))
        SELECT symbol, model, fold, n AS n_train, round(w1, 3) AS "weight_RSI_14", round(w2, 3) AS "weight_Volume_Ratio",
          round(my - w1 / s1 * m1 - w2 / s2 * m2, 3) AS intercept FROM solved""",
    "shap_additivity": f"""WITH {SPLIT} SELECT symbol, model, count(*) AS n, 61::BIGINT AS features, count(*) AS additive
        FROM seg, {MODELS} WHERE split = 'test' GROUP BY ALL""",
    "linear_shap": f"""{SHAP} SELECT symbol, date, 'given' AS model, feature, {wide("shap")} AS shap,
        {wide("feature_value")} AS feature_value FROM shap""",
    "shap_global": f"""{SHAP}, g AS (SELECT symbol, feature, avg(abs(shap)) AS m FROM shap GROUP BY ALL)
        SELECT symbol, 'given' AS model, feature, {wide("m")} AS mean_abs_shap,
          CAST(row_number() OVER (PARTITION BY symbol ORDER BY m DESC, feature) AS INTEGER) AS rank FROM g
        QUALIFY rank <= 20""",
    "shap_local": f"""{SHAP} SELECT symbol, date, 'given' AS model, feature, {wide("shap")} AS shap,
        {wide("feature_value")} AS feature_value,
        CAST(row_number() OVER (PARTITION BY symbol, date ORDER BY abs(shap) DESC, feature) AS INTEGER) AS rank,
        CASE WHEN shap >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM shap QUALIFY rank <= 10""",
    # The layers and the context are there already.
    "shap_by_regime": f"""{SHAP}, {RULED.removeprefix(f"{LAYERS}, {CONTEXT},")}
        SELECT symbol, 'given' AS model, regime, feature, {wide("avg(shap)", 7)} AS mean_shap,
          {wide("avg(abs(shap))", 7)} AS mean_abs_shap FROM shap JOIN labelled USING (symbol, date) GROUP BY ALL""",
    # Exact for an effect of two features: half of what either order gives, over the background rows.
    "regimes_settled": f"""WITH {RULED}
        SELECT symbol, count(*) AS days, count(*) AS settled, 3::BIGINT AS regimes FROM full_days GROUP BY symbol""",
    "sampled_shap": f"""WITH {SPLIT},
        base_ AS (SELECT symbol, "close" AS b1, SMA_5 AS b2 FROM seg WHERE split = 'train'
          QUALIFY row_number() OVER ({W}) <= 8),
        pairs AS (
          SELECT symbol, date, "close" AS x1, SMA_5 AS x2,
            avg(0.5 * ("close" - b1) + ("close" - b1) * (SMA_5 + b2) / 2 / 1e6) AS s1,
            avg(-0.25 * (SMA_5 - b2) + (SMA_5 - b2) * ("close" + b1) / 2 / 1e6) AS s2
          FROM seg JOIN base_ USING (symbol) WHERE split = 'test' GROUP BY ALL)
        SELECT symbol, date, 'pair' AS model, 'close' AS feature, {wide("s1")} AS shap, {wide("x1")} AS feature_value FROM pairs
        UNION ALL
        SELECT symbol, date, 'pair', 'SMA_5', {wide("s2")}, {wide("x2")} FROM pairs""",
    "bars_round_trip": f"""WITH {BARS} SELECT symbol, date, open, high, low, "close", volume FROM bars
        WHERE symbol IN ('AF', 'RO') AND date >= DATE '1996-01-01' AND date < DATE '1999-01-01'""",
    "snapshot_round_trip": f"""WITH {LAYERS}, s AS (SELECT symbol, date, open, high, low, "close", volume,
        rn, n FROM l3) SELECT symbol, date, open, high, low, "close", volume FROM s
        WHERE rn >= 20 AND rn < n""",
    "tables_round_trip": f"""WITH {BARS} SELECT symbol, date, open, high, low, "close", volume FROM bars
        QUALIFY date = max(date) OVER (PARTITION BY symbol)""",
    "summary": f"""{CORR}, {FACTS},
        rets AS (SELECT symbol, date, ("close" / nullif(lag("close") OVER ({W}), 0) - 1) * 100 AS r FROM bars),
        moments AS (SELECT symbol, avg(r) AS mean, kurtosis(r) AS k FROM rets GROUP BY symbol),
        days AS (SELECT symbol, strftime(min(date), '%a') AS d, avg(r) AS r FROM rets WHERE r IS NOT NULL
          GROUP BY symbol, isodow(date)),
        effects AS (SELECT symbol, arg_max(d, r) AS best_day, arg_min(d, r) AS worst_day,
          CASE WHEN max(r) - min(r) > 0.1 THEN 'Detected' ELSE 'Minimal' END AS effect FROM days
          GROUP BY symbol),
        counts AS (SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol),
        best AS (SELECT symbol, feature, v, row_number() OVER (PARTITION BY symbol
          ORDER BY round(v, 9) DESC NULLS LAST, feature) AS place FROM corr_long),
        tops AS (SELECT symbol, max(feature) FILTER (place = 1) AS top_feature,
          round(max(v) FILTER (place = 5), 6) AS fifth_corr FROM best GROUP BY symbol)
        SELECT symbol, longName, n_bars, 61 AS n_features, 100.0::DOUBLE AS completeness,
          round(mean, 6) AS mean, round(k, 6) AS kurtosis,
          CASE WHEN k > 3 THEN 'Fat tails' ELSE 'Normal tails' END AS tail_label,
          best_day, worst_day, effect, top_feature, fifth_corr
        FROM counts JOIN moments USING (symbol) JOIN effects USING (symbol) JOIN tops USING (symbol)
        JOIN facts USING (symbol)""",
    "summary_text": f"""{CORR}, {FACTS},
        rets AS (SELECT symbol, date, ("close" / nullif(lag("close") OVER ({W}), 0) - 1) * 100 AS r FROM bars),
        moments AS (SELECT symbol, avg(r) AS mean, stddev_samp(r) AS std, skewness(r) AS skew,
          kurtosis(r) AS kurt FROM rets GROUP BY symbol),
        days AS (SELECT symbol, strftime(min(date), '%a') AS d, avg(r) AS r FROM rets WHERE r IS NOT NULL
          GROUP BY symbol, isodow(date)),
        effects AS (SELECT symbol, arg_max(d, r) AS best, max(r) AS high, arg_min(d, r) AS worst, min(r) AS low
          FROM days GROUP BY symbol),
        spans AS (SELECT symbol, min(date) AS a, max(date) AS z, count(*) AS n FROM bars GROUP BY symbol),
        strong AS (SELECT symbol, feature, v, row_number() OVER (PARTITION BY symbol
          ORDER BY round(v, 9) DESC NULLS LAST, feature) AS place FROM corr_long)
        SELECT symbol, unnest(['symbol = ' || symbol, 'first_date = ' || strftime(a, '%Y-%m-%d'),
          'last_date = ' || strftime(z, '%Y-%m-%d'), 'n_bars = ' || n, 'n_columns = 5', 'completeness = 100.0000',
          printf('mean = %.4f', mean), printf('std = %.4f', std), printf('skewness = %.4f', skew),
          printf('kurtosis = %.4f', kurt),
          'skew_label = ' || CASE WHEN skew > 0 THEN 'Right-skewed' ELSE 'Left-skewed' END,
          'tail_label = ' || CASE WHEN kurt > 3 THEN 'Fat tails' ELSE 'Normal tails' END,
          'shape_label = ' || CASE WHEN abs(skew) < 0.5 THEN 'Approximately normal' ELSE 'Deviates from normal' END,
          'best_day = ' || best, printf('best_return = %.4f', high), 'worst_day = ' || worst,
          printf('worst_return = %.4f', low),
          'effect = ' || CASE WHEN high - low > 0.1 THEN 'Detected' ELSE 'Minimal' END, 'n_features = 61',
          'longName = ' || longName]) AS value
        FROM spans JOIN moments USING (symbol) JOIN effects USING (symbol) JOIN facts USING (symbol)
        UNION ALL
        SELECT symbol, printf('top_features = %d %s %.4f', place, feature, v) FROM strong WHERE place <= 5""",
    "tick_bars": """SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour,
        arg_min("value", ts) AS open, max("value") AS high, min("value") AS low,
        arg_max("value", ts) AS "close", count(*) AS ticks FROM events GROUP BY ALL""",
}
