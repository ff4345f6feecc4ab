"""Registered queries for reports, evaluation, importances and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.fixed import VALUE_COLUMNS
from tidemark.functions.calendar import business_days, last_dates
from tidemark.functions.text import market_cap, percentage
from tidemark.operators import cleaning, importance, keyfigures, seasonality, stats
from tidemark.operators.averages import sma
from tidemark.plans import evaluation, forecast, regimes
from tidemark.plans.features import feature_names, feature_table
from tidemark.series import in_one_pass
from tidemark.operators import candles
from tidemark.sources.bars import from_wide, in_universe, lineitem_bars
from tidemark.sources.context import company_facts, join_context, lineitem_facts, orders_context
from tidemark.sources.context import read_series
from tidemark.sources.sinks import staged

SCALED = ["Daily_Return", "HV_5", "HV_21", "Volume_Ratio", "RSI_14", "BB_Pct"]


def digits(df, **places):
    """Round the named columns; the others stay."""
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _bars(spark, sf_dir):
    return lineitem_bars(spark, sf_dir)


def _gappy(spark, sf_dir):
    return _bars(spark, sf_dir).withColumns(
        {
            "close": F.when(F.col("high") > F.col("low"), F.col("close")),
            "volume": F.when(F.col("volume") > 25, F.col("volume")),
        }
    )


def _returns(spark, sf_dir):
    return stats.percent_returns(_bars(spark, sf_dir))


def _facts(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    symbols = lines.select(F.concat("l_returnflag", "l_linestatus").alias("symbol")).distinct()
    return company_facts(symbols, lineitem_facts(spark, sf_dir))


def universe_filter(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(F.col("l_linestatus") == "O")
    symbols = lines.select(F.concat("l_returnflag", "l_linestatus").alias("symbol")).distinct()
    chosen = in_universe(_bars(spark, sf_dir), symbols)
    return chosen.groupBy("symbol").agg(F.count("*").alias("n"))


def wide_to_long(spark, sf_dir):
    # A wide file has a column for each symbol, so its reader knows them.
    symbols = [r["symbol"] for r in _bars(spark, sf_dir).select("symbol").distinct().orderBy("symbol").collect()]
    fields = [F.first(c).alias(c.capitalize()) for c in VALUE_COLUMNS]
    wide = _bars(spark, sf_dir).groupBy("date").pivot("symbol", symbols).agg(*fields)
    renamed = [
        F.col(f"{s}_{c.capitalize()}").alias(f"{c.capitalize()}_{s}")
        for s in symbols
        for c in VALUE_COLUMNS
    ]
    return from_wide(wide.select(F.col("date").alias("Date"), *renamed), symbols)


def snapshot(spark, sf_dir):
    return digits(cleaning.training_snapshot(_bars(spark, sf_dir)), MA5=4, MA20=4)


def company(spark, sf_dir):
    out = _facts(spark, sf_dir).select(
        "symbol", "longName", "sector", "industry", "recommendationKey", "marketCap", "trailingPE",
        "forwardPE", "priceToBook", "dividendYield", "beta", "shortRatio", "revenueGrowth",
    )
    return digits(out, trailingPE=6, forwardPE=6, priceToBook=6, dividendYield=6, beta=6)


def fact_sheet(spark, sf_dir):
    return keyfigures.fact_sheet(_facts(spark, sf_dir))


def market_cap_text(spark, sf_dir):
    worth = F.col("close") * F.col("volume")
    return _bars(spark, sf_dir).select(
        "symbol", "date", market_cap(worth).alias("market_cap"), percentage(worth / 1e9).alias("share")
    )


def profile(spark, sf_dir):
    return stats.profile(_bars(spark, sf_dir))


def column_types(spark, sf_dir):
    return stats.column_types(_bars(spark, sf_dir))


def missing(spark, sf_dir):
    return stats.missing_counts(_gappy(spark, sf_dir))


def completeness(spark, sf_dir):
    return digits(stats.completeness(_gappy(spark, sf_dir)), completeness=6)


def complete_rows(spark, sf_dir):
    rows = _gappy(spark, sf_dir)
    pair = ["close", "volume"]
    count = F.count("*")
    out = rows.groupBy("symbol").agg(count.alias("bars"))
    full = cleaning.complete_rows(rows, pair).groupBy("symbol").agg(count.alias("complete"))
    some = cleaning.not_empty_rows(rows, pair).groupBy("symbol").agg(count.alias("not_empty"))
    out = out.join(full, "symbol", "left").join(some, "symbol", "left")
    return out.fillna(0, ["complete", "not_empty"])


def minimum_rows(spark, sf_dir):
    yearly = _bars(spark, sf_dir).withColumn("symbol", F.concat("symbol", F.year("date")))
    kept = cleaning.enough_rows(yearly, 355)
    return kept.groupBy("symbol").agg(F.count("*").alias("n_bars"))


def head(spark, sf_dir):
    return stats.head(_bars(spark, sf_dir))


def describe(spark, sf_dir):
    return digits(stats.describe(_bars(spark, sf_dir)), mean=4, std=2)


def return_moments(spark, sf_dir):
    out = stats.moments(_returns(spark, sf_dir))
    return digits(out, mean=6, std=6, skewness=6, kurtosis=6)


def _histogram(bins):
    def query(spark, sf_dir):
        out = stats.histogram(_returns(spark, sf_dir), bins)
        return digits(out.select("symbol", "bin", "low_edge", "count", "mean"), low_edge=6, mean=6)

    return query


def return_ranks(spark, sf_dir):
    ranked = stats.with_rank(_returns(spark, sf_dir), "ret_pct")
    return ranked.select("symbol", "date", "rank", "n_ranked")


def quantile_plot(spark, sf_dir):
    points = stats.quantile_plot(_returns(spark, sf_dir))
    return digits(points, ordered=6, position=9, theoretical=6)


def quantile_line(spark, sf_dir):
    line = stats.quantile_line(stats.quantile_plot(_returns(spark, sf_dir)))
    return digits(line, slope=6, intercept=6, r=6)


def _features(spark, sf_dir):
    return feature_table(_bars(spark, sf_dir))


def corr_topk(spark, sf_dir):
    features = _features(spark, sf_dir)
    top = stats.top_correlations(features, feature_names(features))
    return digits(top.select("symbol", "rank", "feature", "abs_corr"), abs_corr=6)


def correlations(spark, sf_dir):
    features = _features(spark, sf_dir)
    out = stats.target_correlations(features, feature_names(features))
    return digits(out.dropna(subset=["abs_corr"]), abs_corr=6)


def monthly_seasonality(spark, sf_dir):
    out = seasonality.monthly_grid(_returns(spark, sf_dir))
    return digits(out, **{c: 6 for c in out.columns[2:]})


def dow_seasonality(spark, sf_dir):
    return digits(seasonality.weekday_means(_returns(spark, sf_dir)), mean_return=6)


def dow_effect(spark, sf_dir):
    out = seasonality.weekday_effect(seasonality.weekday_means(_returns(spark, sf_dir)))
    return digits(out, best_return=6, worst_return=6)


def annual_return(spark, sf_dir):
    return digits(seasonality.annual_return(_bars(spark, sf_dir)), annual_return=6)


def year_range(spark, sf_dir):
    return keyfigures.year_range(_bars(spark, sf_dir))


def last_rows(spark, sf_dir):
    return keyfigures.last_rows(_bars(spark, sf_dir)).select("symbol", "date", "close", "from_end")


def kpi(spark, sf_dir):
    return digits(keyfigures.key_figures(_bars(spark, sf_dir)), change_pct=6)


def kpi_text(spark, sf_dir):
    figures = keyfigures.key_figures(_bars(spark, sf_dir))
    facts = _facts(spark, sf_dir)
    # Few digits, so that both engines print the same text.
    facts = facts.withColumn("trailingPE", F.round("trailingPE", 3))
    return keyfigures.key_figure_texts(figures, facts)


def next_business_days(spark, sf_dir):
    return business_days(last_dates(_bars(spark, sf_dir)), 30)


# ---- evaluation on two deterministic predictors ---------------------------------------------------


def _segments(spark, sf_dir):
    """Feature rows (complete lags and label) with split and segment."""
    operators = [(sma, {"windows": [5]}), (candles.lags, {}), (candles.target, {})]
    rows = in_one_pass(_bars(spark, sf_dir), operators)
    rows = rows.dropna(subset=["Close_Lag20", "Target"])
    return evaluation.with_segments(rows.select("symbol", "date", "close", "SMA_5", "Target"))


def _predictions(spark, sf_dir):
    columns = {"last close": "close", "mean of five": "SMA_5"}
    return evaluation.baseline_predictions(_segments(spark, sf_dir), columns)


def _scores(spark, sf_dir):
    predictions = _predictions(spark, sf_dir)
    valid = predictions.filter(F.col("segment").between(1, evaluation.FOLDS))
    return evaluation.fold_scores(valid.withColumn("fold", F.col("segment") - 1))


def _metrics(spark, sf_dir):
    return evaluation.metrics(_predictions(spark, sf_dir))


def time_split(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("symbol", "split").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )


def cv_folds(spark, sf_dir):
    return evaluation.fold_sizes(_segments(spark, sf_dir))


def metrics(spark, sf_dir):
    return digits(_metrics(spark, sf_dir), RMSE=2, MAE=2, R2=6, MAPE=6, Direction_Acc=6)


def metrics_long(spark, sf_dir):
    return digits(evaluation.metrics_long(_metrics(spark, sf_dir)), value=4)


def cv_scores(spark, sf_dir):
    return digits(_scores(spark, sf_dir), r2=6)


def cv_summary(spark, sf_dir):
    return evaluation.summary(_metrics(spark, sf_dir), _scores(spark, sf_dir))


def cv_distribution(spark, sf_dir):
    out = evaluation.score_distribution(_scores(spark, sf_dir))
    return digits(out, low=6, q25=6, median=6, q75=6, high=6)


def best_model(spark, sf_dir):
    out = evaluation.best_models(_metrics(spark, sf_dir)).select("symbol", "model", "RMSE")
    return digits(out, RMSE=2)


def best_predictions(spark, sf_dir):
    best = evaluation.best_models(_metrics(spark, sf_dir))
    out = evaluation.best_predictions(_predictions(spark, sf_dir), best)
    return digits(out.select("symbol", "date", "model", "y", "yhat"), yhat=4)


def direction_pairs(spark, sf_dir):
    test = _predictions(spark, sf_dir).filter(F.col("split") == "test")
    return evaluation.with_steps(test).groupBy("symbol", "model").agg(
        F.count("*").alias("n"),
        F.count("same_direction").alias("pairs"),
        F.count_if(F.col("same_direction") == 1).alias("hits"),
    )


def residuals(spark, sf_dir):
    out = evaluation.residual_bands(_predictions(spark, sf_dir)).drop("y", "yhat")
    return digits(out, residual=4, sigma=2, lower=2, upper=2)


def scatter_limits(spark, sf_dir):
    return digits(evaluation.scatter_limits(_predictions(spark, sf_dir)), low=4, high=4)


def first_test_rows(spark, sf_dir):
    test = _segments(spark, sf_dir).filter(F.col("split") == "test")
    rows = evaluation.first_rows(test, 100)
    return rows.select("symbol", "date", "close", F.col("Target").alias("y"))


def timeline(spark, sf_dir):
    predictions = _predictions(spark, sf_dir)
    test = predictions.filter(F.col("split") == "test")
    flat = test.groupBy("symbol", "model").agg(
        F.max_by("yhat", "date").alias("yhat"), F.max("date").alias("last_date")
    )
    steps = flat.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(7))))
    future = forecast.with_band(
        forecast.dated(steps, 7), evaluation.residual_sigma(predictions)
    )
    return digits(evaluation.timeline(predictions, future), yhat=2, lower=2, upper=2)


# ---- importances from correlations with the label and with its change -----------------------------


def _importances(spark, sf_dir):
    features = _features(spark, sf_dir)
    names = feature_names(features)
    change = features.withColumn("Change", F.col("Target") - F.col("close"))
    parts = [
        stats.target_correlations(features, names).withColumn("model", F.lit("level")),
        stats.target_correlations(change, names, "Change").withColumn("model", F.lit("change")),
    ]
    both = parts[0].unionByName(parts[1]).dropna(subset=["abs_corr"])
    return both.select("symbol", "model", "feature", F.round("abs_corr", 6).alias("importance"))


def importance_top(spark, sf_dir):
    return importance.top_features(_importances(spark, sf_dir))


def importance_relative(spark, sf_dir):
    out = importance.relative_importance(_importances(spark, sf_dir)).drop("importance")
    return digits(out, relative=4)


def importance_groups(spark, sf_dir):
    return digits(importance.group_importance(_importances(spark, sf_dir)), total=6)


def importance_cumulative(spark, sf_dir):
    return digits(importance.cumulative_importance(_importances(spark, sf_dir)), cumulative=4)


def importance_to_80(spark, sf_dir):
    return importance.features_to_reach(importance.cumulative_importance(_importances(spark, sf_dir)))


def model_comparison(spark, sf_dir):
    return importance.model_comparison(_importances(spark, sf_dir))


# ---- regimes by rule ------------------------------------------------------------------------------


def _context_bars(spark, sf_dir):
    context = orders_context(spark, sf_dir)
    return join_context(
        _bars(spark, sf_dir), read_series(context, "VIX"), read_series(context, "SP500")
    )


def regime_features(spark, sf_dir):
    out = regimes.regime_features(_context_bars(spark, sf_dir)).drop("close")
    return digits(out, VIX=2, SP500_Return=6, **{c: 6 for c in SCALED})


def regime_features_dashboard(spark, sf_dir):
    out = regimes.regime_features(_context_bars(spark, sf_dir), dashboard=True).drop("close")
    return digits(out, VIX=2, Daily_Return=6, HV_5=6, HV_21=6, Volume_Ratio=6)


def _ruled(spark, sf_dir):
    days = staged(regimes.regime_features(_bars(spark, sf_dir)), "regime-features")
    rule = F.when(F.col("RSI_14") >= 60, 10).when(F.col("BB_Pct") < 0.3, 20).otherwise(30)
    return regimes.by_mean_return(days.withColumn("cluster", rule))


def regime_ruled(spark, sf_dir):
    out = _ruled(spark, sf_dir).select(
        "symbol", "date", "close", "HV_21", "Daily_Return", "regime", "regime_label"
    )
    return digits(out, HV_21=6, Daily_Return=6)


def regime_stats(spark, sf_dir):
    return regimes.regime_statistics(_ruled(spark, sf_dir))


def regime_means(spark, sf_dir):
    return digits(regimes.regime_means(_ruled(spark, sf_dir)), mean_return=5)


def regime_centres(spark, sf_dir):
    out = regimes.regime_centres(_ruled(spark, sf_dir), SCALED)
    return digits(out, **{c: 5 for c in SCALED})


def silhouette(spark, sf_dir):
    ruled = staged(_ruled(spark, sf_dir), "ruled")
    points = staged(regimes.scaled_points(ruled, SCALED, keep=["regime"]), "points")
    out = regimes.silhouette(points, ["regime"]).select("symbol", "silhouette")
    return digits(out, silhouette=6)


QUERIES = {
    "universe_filter": universe_filter,
    "wide_to_long": wide_to_long,
    "snapshot": snapshot,
    "company_facts": company,
    "fact_sheet": fact_sheet,
    "market_cap_text": market_cap_text,
    "profile": profile,
    "column_types": column_types,
    "missing": missing,
    "completeness": completeness,
    "complete_rows": complete_rows,
    "minimum_rows": minimum_rows,
    "head": head,
    "describe": describe,
    "return_moments": return_moments,
    "histogram": _histogram(50),
    "histogram_fine": _histogram(80),
    "return_ranks": return_ranks,
    "qq": quantile_plot,
    "qq_line": quantile_line,
    "corr_topk": corr_topk,
    "correlations": correlations,
    "monthly_seasonality": monthly_seasonality,
    "dow_seasonality": dow_seasonality,
    "dow_effect": dow_effect,
    "annual_return": annual_return,
    "year_range": year_range,
    "last_rows": last_rows,
    "kpi": kpi,
    "kpi_text": kpi_text,
    "business_days": next_business_days,
    "time_split": time_split,
    "cv_folds": cv_folds,
    "metrics": metrics,
    "metrics_long": metrics_long,
    "cv_scores": cv_scores,
    "cv_summary": cv_summary,
    "cv_distribution": cv_distribution,
    "best_model": best_model,
    "best_predictions": best_predictions,
    "direction_pairs": direction_pairs,
    "residuals": residuals,
    "scatter_limits": scatter_limits,
    "first_test_rows": first_test_rows,
    "timeline": timeline,
    "importance_top": importance_top,
    "importance_relative": importance_relative,
    "importance_groups": importance_groups,
    "importance_cumulative": importance_cumulative,
    "importance_to_80": importance_to_80,
    "model_comparison": model_comparison,
    "regime_features": regime_features,
    "regime_features_dashboard": regime_features_dashboard,
    "regime_ruled": regime_ruled,
    "regime_stats": regime_stats,
    "regime_means": regime_means,
    "regime_centres": regime_centres,
    "silhouette": silhouette,
}
