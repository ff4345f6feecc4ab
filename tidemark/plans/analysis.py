"""One analysis request from bars to tables, as a user starts it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import MODEL_NAMES
from tidemark.operators import keyfigures
from tidemark.plans import evaluation, forecast
from tidemark.plans.features import feature_table, indicators
from tidemark.plans.training import LINEAR_MODELS, PER_SYMBOL, Training, train_all
from tidemark.series import laid_out, without_positions
from tidemark.sources.sinks import staged


def forecast_all(
    training: Training,
    start: DataFrame,
    n_days: int,
    models=None,
    mode: str = forecast.HISTORY,
    stride: int = 1,
) -> DataFrame:
    """Dated forecasts with a band, for the given models of every symbol.

    ``stride`` is the label horizon of the models: a step goes so many weekdays ahead.
    """
    models = list(models or MODEL_NAMES)
    parts = []
    linear = [m for m in models if m in LINEAR_MODELS]
    if linear and training.linear is not None:
        chosen = training.linear.filter(F.col("model").isin(linear))
        parts.append(forecast.forecast_linear(start, chosen, training.names, n_days, mode, stride))
    if training.trees is not None:
        chosen = training.trees.filter(F.col("model").isin(models))
        parts.append(forecast.forecast_trees(start, chosen, training.names, n_days, mode, stride))
    for (group, name), pipeline in training.fitted.items():
        if name in models:
            rows = start if group == "*" else start.filter(F.col("symbol") == group)
            parts.append(
                forecast.forecast_pipeline(rows, pipeline, name, training.names, n_days, mode, stride)
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    sigma = evaluation.residual_sigma(training.predictions)
    return forecast.with_band(forecast.dated(out, n_days, stride), sigma)


def prepared(bars: DataFrame, horizon: int = 1) -> tuple[DataFrame, DataFrame]:
    """The feature table, computed and stored once: all rows, and the complete ones that training uses."""
    rows = staged(feature_table(bars, horizon=horizon, drop_incomplete=False), "features")
    return rows, rows.dropna(how="any", subset=[c for c in rows.columns if c not in ("symbol", "date")])


def starting_rows(rows: DataFrame, bars: DataFrame, training: Training, mode: str, from_last_bar: bool = True) -> DataFrame:
    """Rows from which forecasts start: the last bar with all features, or the last one with a label."""
    usable = rows.dropna(subset=training.names) if from_last_bar else training.features
    return staged(forecast.starting_rows(usable, bars, training.names, mode), "forecast-start")


def run_analysis(
    bars: DataFrame,
    facts: DataFrame | None = None,
    horizon: int = 1,
    future_days: int = 30,
    models=MODEL_NAMES,
    scope: str = PER_SYMBOL,
    symbols: list[str] | None = None,
    mode: str = forecast.HISTORY,
    validate: bool = True,
    from_last_bar: bool = True,
) -> dict[str, DataFrame]:
    """Bars, indicators, predictions, metrics, importances, forecast and key figures.

    The forecast is that of the best model of each symbol.  It starts at the last bar, or with
    ``from_last_bar=False`` at the last row that has a label.
    """
    placed = laid_out(bars)
    bars = without_positions(placed)
    rows, features = prepared(placed, horizon)
    training = train_all(
        features, models, scope=scope, symbols=symbols, validate=validate
    )
    best = training.best()
    start = starting_rows(rows, bars, training, mode, from_last_bar)
    future = forecast_all(training, start, future_days, models, mode, stride=horizon)
    future = future.join(best.select("symbol", "model"), ["symbol", "model"], "left_semi")
    tables = {
        "bars": bars,
        "indicators": indicators(placed),
        "predictions": training.predictions,
        "metrics": training.summary() if validate else training.metrics(),
        "importances": training.importances,
        "best": best,
        "forecast": future,
        "timeline": evaluation.timeline(
            evaluation_rows(training, best), future
        ),
        "key_figures": keyfigures.key_figures(bars),
    }
    if facts is not None:
        tables["key_figure_texts"] = keyfigures.key_figure_texts(
            tables["key_figures"], facts, best
        )
    return tables


def evaluation_rows(training: Training, best: DataFrame) -> DataFrame:
    """Train and test predictions of the best model of each symbol."""
    chosen = best.select("symbol", "model")
    return training.predictions.join(chosen, ["symbol", "model"], "left_semi")
