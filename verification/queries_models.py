"""Registered queries that fit models, forecast, cluster, explain, write and stream."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.fixed import BOOSTING, FOREST, LINEAR, MODEL_NAMES, RIDGE, XGBOOST
from tidemark.plans import evaluation, explain, forecast, regimes
from tidemark.plans.analysis import forecast_all, prepared, run_analysis, starting_rows
from tidemark.plans.features import feature_names, feature_table
from tidemark.plans.linear import FINAL, fit_linear
from tidemark.plans.summary import report_text, summary_table
from tidemark.plans.training import train_all
from tidemark.plans.trees import Settings
from tidemark.series import in_one_pass, laid_out, with_positions
from tidemark.session import shared_folder
from tidemark.operators import candles
from tidemark.operators.cleaning import training_snapshot
from tidemark.sources.bars import lineitem_bars, read_bars, read_snapshot
from tidemark.sources.sinks import (
    read_tables,
    staged,
    write_bars,
    write_report,
    write_snapshot,
    write_tables,
)
from tidemark.streaming.live import bars_from_ticks, event_ticks
from verification.queries_reports import _facts, _ruled, _segments

LINEAR_SET = (LINEAR, RIDGE)


def _fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _training(spark, sf_dir, models=MODEL_NAMES, **options):
    _, features = prepared(lineitem_bars(spark, sf_dir))
    return train_all(features, models, **options)


# ---- training --------------------------------------------------------------------------------------


def train_linear(spark, sf_dir):
    return _training(spark, sf_dir, LINEAR_SET).summary()


def train_five(spark, sf_dir):
    """Every model of every symbol with its folds, as one request trains them."""
    return _training(spark, sf_dir).summary()


def train_predictions(spark, sf_dir):
    return _training(spark, sf_dir).predictions


def fold_predictions(spark, sf_dir):
    return _training(spark, sf_dir).fold_predictions


def _tree(model):
    def query(spark, sf_dir):
        return _training(spark, sf_dir, [model]).summary()

    return query


def _stump(model, **settings):
    """First split of every symbol with all candidate cuts, as sizes and values of its two sides."""

    def query(spark, sf_dir):
        one = {model: Settings(trees=1, depth=1, bins=1 << 15, **settings)}
        training = _training(spark, sf_dir, [model], validate=False, settings=one)
        sides = training.predictions.filter(F.col("split") == "train").groupBy("symbol", F.round("yhat", 5).alias("yhat"))
        return sides.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 5).alias("mean_y"))

    return query


PAIR = ["RSI_14", "Volume_Ratio"]


def linear_pair(spark, sf_dir):
    """Both linear models of two features, with all folds."""
    rows = staged(evaluation.with_segments(prepared(lineitem_bars(spark, sf_dir))[1]), "segments")
    models = fit_linear(rows, PAIR)
    return models.select(
        F.col("grp").alias("symbol"),
        "model",
        "fold",
        "n_train",
        *[F.round(F.col("weights")[i], 3).alias(f"weight_{c}") for i, c in enumerate(PAIR)],
        F.round("intercept", 3).alias("intercept"),
    )


def collinear_features(spark, sf_dir):
    """Features that the linear models of each symbol leave out because others determine them."""
    training = _training(spark, sf_dir, [LINEAR], drop_collinear=True)
    final = training.linear.filter(F.col("fold") == FINAL)
    return final.select(F.col("grp").alias("symbol"), F.explode("dropped").alias("feature"))


def importances(spark, sf_dir):
    return _training(spark, sf_dir).importances


def _forecast(mode, best=False):
    def query(spark, sf_dir):
        bars = laid_out(lineitem_bars(spark, sf_dir))
        rows, features = prepared(bars)
        training = train_all(features)
        start = starting_rows(rows, bars, training, mode)
        future = forecast_all(training, start, 30, mode=mode)
        if best:
            future = future.join(training.best().select("symbol", "model"), ["symbol", "model"], "left_semi")
        return future

    return query


# Weights of many digits, so that no value lies halfway between two rounded ones.
GIVEN = {
    "Close_Lag1": 0.5501337,
    "Close_Lag2": 0.2498713,
    "Close_Lag3": 0.0502171,
    "Close_Lag5": 0.0997931,
    "Close_Lag10": 0.0201719,
    "Close_Lag20": 0.0198311,
}


def _forecast_given(mode, stride=1):
    """Thirty steps of a model with given weights of the lags, from the last bar of each symbol."""

    def query(spark, sf_dir):
        bars = laid_out(lineitem_bars(spark, sf_dir))
        rows = in_one_pass(bars, [(candles.lags, {})]).dropna(subset=list(GIVEN))
        start = forecast.starting_rows(rows, bars, list(GIVEN), mode)
        models = start.select(
            F.col("symbol").alias("grp"),
            F.lit("given").alias("model"),
            F.lit(FINAL).alias("fold"),
            F.lit(10_000.0).alias("intercept"),
            F.array(*map(F.lit, GIVEN.values())).alias("beta"),
        )
        out = forecast.forecast_linear(start, models, list(GIVEN), 30, mode, stride)
        return out.select("symbol", "last_date", "step", F.round("yhat", 3).alias("yhat"))

    return query


def analysis(spark, sf_dir):
    tables = run_analysis(
        lineitem_bars(spark, sf_dir), _facts(spark, sf_dir), future_days=14
    )
    return tables["key_figure_texts"]


# ---- regimes ---------------------------------------------------------------------------------------


def kmeans_regimes(spark, sf_dir):
    return regimes.run_regimes(lineitem_bars(spark, sf_dir), with_elbow=False)["stats"]


def _fitted(table):
    def query(spark, sf_dir):
        return regimes.run_regimes(lineitem_bars(spark, sf_dir), with_elbow=False)[table]

    return query


def regimes_settled(spark, sf_dir):
    """Days of each symbol, and those that lie nearest to the mean of their own fitted regime."""
    features = staged(regimes.regime_features(lineitem_bars(spark, sf_dir)), "regime-features")
    names = regimes.regime_columns(features)
    days = staged(regimes.scaled_points(features, names), "regime-points")
    # Until no centre moves at all.
    models = regimes.fit_kmeans(days, len(names), restarts=2, tolerance=1e-24)
    points = staged(regimes.by_mean_return(regimes.label_points(days, models).drop("k")), "points")
    one = [F.col("x")[i] for i in range(len(names))]
    means = points.groupBy("symbol", "regime").agg(F.array(*[F.avg(c) for c in one]).alias("mean"))
    means = means.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("regime", "mean"))).alias("means"))

    def gap(m):
        squares = F.zip_with(m["mean"], F.col("x"), lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0.0), lambda t, v: t + v).alias("d"), m["regime"].alias("regime"))

    nearest = F.array_min(F.transform("means", gap))["regime"]
    return points.join(means, "symbol").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(nearest == F.col("regime")).alias("settled"),
        F.count_distinct("regime").alias("regimes"),
    )


def kmeans_elbow(spark, sf_dir):
    return regimes.run_regimes(lineitem_bars(spark, sf_dir))["elbow"]


# ---- Shapley values --------------------------------------------------------------------------------

def shap_weight(place: int) -> float:
    """Weight of a feature by its place in the table: growing, with changing sign."""
    return round((place + 1) * 0.0137 * (-1) ** place, 4)


def _fixed_shap(spark, sf_dir):
    """Values of a linear model of all features with given weights, centred at the training means, on all test rows."""
    features = prepared(lineitem_bars(spark, sf_dir))[1]
    names = sorted(feature_names(features))
    rows = staged(evaluation.with_segments(features), "segments")
    means = rows.filter(F.col("split") == "train").groupBy("symbol").agg(
        F.array(*[F.avg(c) for c in names]).alias("center")
    )
    models = means.select(
        F.col("symbol").alias("grp"),
        F.lit("given").alias("model"),
        F.lit(FINAL).alias("fold"),
        F.array(*[F.lit(shap_weight(i)) for i in range(len(names))]).alias("beta"),
        "center",
    )
    return explain.linear_shap(rows.filter(F.col("split") == "test"), models, names)


def _wide(df, *columns, digits=5):
    """Round by size: whole numbers from 1,000 on, some digits below; no negative zero.

    The last digits of a mean depend on the order of its sum, so values halfway between two are pushed off it first.
    """

    def rounded(c):
        c = c * (1 + 1e-10)
        return F.when(F.abs(c) >= 1000, F.round(c, 0)).otherwise(F.round(c, digits)) + F.lit(0.0)

    return df.withColumns({c: rounded(F.col(c)) for c in columns})


def linear_shap(spark, sf_dir):
    return _wide(_fixed_shap(spark, sf_dir), "shap", "feature_value")


def shap_global(spark, sf_dir):
    return _wide(explain.global_importance(_fixed_shap(spark, sf_dir)), "mean_abs_shap")


def shap_local(spark, sf_dir):
    return _wide(explain.local_explanation(_fixed_shap(spark, sf_dir)), "shap", "feature_value")


def shap_by_regime(spark, sf_dir):
    days = _ruled(spark, sf_dir).select("symbol", "date", "regime")
    return _wide(explain.regime_summary(_fixed_shap(spark, sf_dir), days), "mean_shap", "mean_abs_shap", digits=7)


def shap_by_fitted_regime(spark, sf_dir):
    """Values of the best model of each symbol by its fitted regimes."""
    bars = staged(lineitem_bars(spark, sf_dir), "bars")
    training = train_all(prepared(bars)[1])
    shap = explain.run_explanation(training)["shap"]
    return explain.regime_summary(shap, regimes.run_regimes(bars, with_elbow=False)["labels"])


SAMPLED = ["close", "SMA_5"]


def sampled_shap(spark, sf_dir):
    """Sampled values of a model with an effect of a pair of features, against the first training rows."""
    rows = staged(_segments(spark, sf_dir), "segments")
    first = with_positions(rows.filter(F.col("split") == "train")).filter(F.col("pos") <= 8)
    values = F.array(*[F.col(c).cast("double") for c in SAMPLED]).alias("base")
    base = first.select("symbol", F.lit(8).alias("n_base"), (F.col("pos") - 1).cast("int").alias("i"), values)

    def score(table):
        x = vector_to_array("features")
        return table.withColumn("prediction", 0.5 * x[0] - 0.25 * x[1] + x[0] * x[1] / 1e6)

    test = rows.filter(F.col("split") == "test")
    out = explain.sampled_shap(test, base, score, "pair", SAMPLED, permutations=8)
    return _wide(out.drop("error"), "shap", "feature_value")


def tree_shap(spark, sf_dir):
    training = _training(spark, sf_dir, [FOREST])
    return explain.run_explanation(training, FOREST)["global_importance"]


def best_model_shap(spark, sf_dir):
    return explain.run_explanation(_training(spark, sf_dir))["global_importance"]


def shap_additivity(spark, sf_dir):
    """Whether expected value and Shapley values of all features add up to each test prediction of each model."""
    training = _training(spark, sf_dir, validate=False)
    parts = [explain.explain_rows(training, m, explain.explained_rows(training)) for m in MODEL_NAMES]
    shap = parts[0]
    for part in parts[1:]:
        shap = shap.unionByName(part)
    sums = shap.groupBy("symbol", "date", "model").agg(F.sum("shap").alias("s"), F.count(F.lit(1)).alias("features"))
    rows = sums.join(training.expected(), ["symbol", "model"]).join(training.predictions, ["symbol", "date", "model"])
    gap = F.abs(F.col("expected") + F.col("s") - F.col("yhat")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("yhat"))
    return rows.groupBy("symbol", "model").agg(
        F.count(F.lit(1)).alias("n"), F.min("features").alias("features"), F.count_if(gap).alias("additive")
    )


# ---- sinks, report, stream -------------------------------------------------------------------------


def bars_round_trip(spark, sf_dir):
    path = _fresh(spark, "bars-by-symbol")
    write_bars(lineitem_bars(spark, sf_dir), path)
    return read_bars(spark, path, symbols=["AF", "RO"], start="1996-01-01", end="1999-01-01")


def snapshot_round_trip(spark, sf_dir):
    path = _fresh(spark, "snapshot")
    write_snapshot(training_snapshot(lineitem_bars(spark, sf_dir)), path)
    return read_snapshot(spark, path)


def tables_round_trip(spark, sf_dir):
    bars = lineitem_bars(spark, sf_dir)
    path = _fresh(spark, "tables")
    write_tables({"bars": bars, "last": bars.groupBy("symbol").agg(F.max("date").alias("d"))}, path)
    tables = read_tables(spark, ["bars", "last"], path)
    return tables["bars"].join(
        tables["last"].withColumnRenamed("d", "date"), ["symbol", "date"], "left_semi"
    )


def _summary(spark, sf_dir):
    bars = lineitem_bars(spark, sf_dir)
    return summary_table(bars, feature_table(bars), _facts(spark, sf_dir))


def summary(spark, sf_dir):
    out = _summary(spark, sf_dir).select(
        "symbol",
        "longName",
        "n_bars",
        "n_features",
        "completeness",
        F.round("mean", 6).alias("mean"),
        F.round("kurtosis", 6).alias("kurtosis"),
        "tail_label",
        "best_day",
        "worst_day",
        "effect",
        F.col("top_features")[0]["feature"].alias("top_feature"),
        F.round(F.col("top_features")[4]["abs_corr"], 6).alias("fifth_corr"),
    )
    return out


def summary_text(spark, sf_dir):
    report = report_text(_summary(spark, sf_dir))
    path = _fresh(spark, "report")
    write_report(report, path)
    return spark.read.text(path)


def tick_bars(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars_from_ticks(event_ticks(events), "1 hour").select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("hour"),
        "open",
        "high",
        "low",
        "close",
        F.col("volume").cast("bigint").alias("ticks"),
    )


def ranked_models(spark, sf_dir):
    training = _training(spark, sf_dir)
    order = Window.partitionBy("symbol").orderBy("RMSE", evaluation.registry_rank())
    return training.metrics().withColumn("rank", F.row_number().over(order))


QUERIES = {
    "train_linear": train_linear,
    "train_predictions": train_predictions,
    "train_random_forest": _tree(FOREST),
    "train_gradient_boosting": _tree(BOOSTING),
    "train_xgboost": _tree(XGBOOST),
    "importances": importances,
    "ranked_models": ranked_models,
    "train_five": train_five,
    "fold_predictions": fold_predictions,
    "linear_pair": linear_pair,
    "collinear_features": collinear_features,
    "first_split": _stump(FOREST),
    "first_split_l2": _stump(XGBOOST, rate=0.05, l2=1.0),
    "forecast": _forecast(forecast.HISTORY),
    "forecast_slot_shift": _forecast(forecast.SLOT_SHIFT),
    "forecast_best": _forecast(forecast.HISTORY, best=True),
    "forecast_given": _forecast_given(forecast.HISTORY),
    "forecast_given_week": _forecast_given(forecast.HISTORY, 5),
    "forecast_given_slots": _forecast_given(forecast.SLOT_SHIFT),
    "analysis": analysis,
    "regimes": kmeans_regimes,
    "regimes_fitted": _fitted("labels"),
    "regimes_fitted_centres": _fitted("centres"),
    "regimes_fitted_silhouette": _fitted("silhouette"),
    "regimes_settled": regimes_settled,
    "elbow": kmeans_elbow,
    "linear_shap": linear_shap,
    "shap_global": shap_global,
    "shap_local": shap_local,
    "shap_by_regime": shap_by_regime,
    "shap_by_fitted_regime": shap_by_fitted_regime,
    "sampled_shap": sampled_shap,
    "tree_shap": tree_shap,
    "best_model_shap": best_model_shap,
    "shap_additivity": shap_additivity,
    "bars_round_trip": bars_round_trip,
    "snapshot_round_trip": snapshot_round_trip,
    "tables_round_trip": tables_round_trip,
    "summary": summary,
    "summary_text": summary_text,
    "tick_bars": tick_bars,
}
