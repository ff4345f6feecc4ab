"""Recursive forecasts: each predicted value becomes the latest lag of the next step.

``slot_shift`` moves the lag columns along by one place per step, whatever distance they stand for.
``history`` keeps the recent closes, that of the starting row first, and reads every lag at its
distance: the first step has the lags of the starting row, the second has its close as the first lag,
and predictions follow from the third on.  All other features keep the values of the starting row in
both modes.  Models that look several rows ahead (``stride``) go on by so many weekdays a step; in
``history`` the closes between two steps lie on the line between them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import business_days
from tidemark.plans.features import latest_rows
from tidemark.plans.linear import FINAL
from tidemark.plans.trees import Ensemble
from tidemark.session import shared_folder

SLOT_SHIFT, HISTORY = "slot_shift", "history"
CHECKPOINT_EVERY = 10


def lag_columns(names: list[str]) -> dict[str, int]:
    """Lag columns in feature order with their distance in rows."""
    found = {}
    for name in names:
        match = re.search(r"lag(\d+)$", name, re.IGNORECASE)
        if match:
            found[name] = int(match.group(1))
    return found


def _next_lags(mode: str, lags: dict[str, int], past, value: Column, stride: int = 1) -> Column:
    """State after ``value`` was appended.

    It holds the lags (slots), or the closes from that of the current row backward (history).
    """
    if mode == SLOT_SHIFT:
        return F.slice(F.concat(F.array(value), past), 1, len(lags))
    known = F.get(past, 0)
    between = [value + (known - value) * (i / stride) for i in range(1, stride)]
    return F.slice(F.concat(F.array(value, *between), past), 1, max(lags.values()) + 1)


def _lag_value(mode: str, lags: dict[str, int], past, name: str) -> Column:
    return F.get(past, list(lags).index(name) if mode == SLOT_SHIFT else lags[name])


def starting_rows(features: DataFrame, bars: DataFrame, names: list[str], mode: str) -> DataFrame:
    """The last row of each symbol with its lag state; ``bars`` supplies the recent closes."""
    lags = lag_columns(names)
    start = latest_rows(features).select("symbol", "date", *names)
    if mode == SLOT_SHIFT:
        return start.withColumn("_past", F.array(*[F.col(c).cast("double") for c in lags]))
    depth = max(lags.values()) + 1
    # Closes up to the starting row, newest first; per year only the last ``depth`` go on.
    dated = bars.join(start.select("symbol", F.col("date").alias("_start")), "symbol")
    dated = dated.filter(F.col("date") <= F.col("_start"))
    entries = F.sort_array(F.collect_list(F.struct("date", "close")), asc=False)
    yearly = dated.groupBy("symbol", F.year("date").alias("_year")).agg(
        F.slice(entries, 1, depth).alias("_entries")
    )
    recent = F.slice(F.sort_array(F.flatten(F.collect_list("_entries")), asc=False), 1, depth)
    closes = F.transform(recent, lambda e: e["close"])
    return start.join(yearly.groupBy("symbol").agg(closes.alias("_past")), "symbol")


def forecast_linear(
    start: DataFrame,
    models: DataFrame,
    names: list[str],
    n_days: int,
    mode: str = HISTORY,
    stride: int = 1,
) -> DataFrame:
    """Forecast of the final linear models, one fold over the steps per symbol and model.

    Features other than lags never change, so they form one constant per row.
    """
    lags = lag_columns(names)
    final = models.filter(F.col("fold") == FINAL)
    final = final.select(F.col("grp").alias("symbol"), "model", "intercept", "beta")
    place = {c: i for i, c in enumerate(names)}
    fixed = F.col("intercept")
    for c in names:
        if c not in lags:
            fixed = fixed + F.col(c) * F.col("beta")[place[c]]
    state = start.join(final, "symbol").withColumn("_fixed", fixed)

    def step(acc, _):
        value = F.col("_fixed")
        for c in lags:
            value = value + _lag_value(mode, lags, acc["past"], c) * F.col("beta")[place[c]]
        return F.struct(
            _next_lags(mode, lags, acc["past"], value, stride).alias("past"),
            F.concat(acc["out"], F.array(value)).alias("out"),
        )

    begin = F.struct(
        F.col("_past").alias("past"), F.expr("cast(array() AS array<double>)").alias("out")
    )
    path = F.aggregate(F.sequence(F.lit(1), F.lit(n_days)), begin, step)["out"]
    rows = state.select(
        "symbol", "model", F.col("date").alias("last_date"), F.posexplode(path).alias("_i", "yhat")
    )
    return rows.select("symbol", "model", "last_date", (F.col("_i") + 1).alias("step"), "yhat")


def forecast_trees(
    start: DataFrame,
    models: DataFrame,
    names: list[str],
    n_days: int,
    mode: str = HISTORY,
    stride: int = 1,
) -> DataFrame:
    """Forecast of the final tree ensembles: a row per symbol and model walks all steps in one pass."""
    lags = lag_columns(names)
    places = [names.index(c) for c in lags]
    distances = list(lags.values())
    final = models.filter(F.col("fold") == FINAL).select("symbol", "model", "ensemble")
    values = F.array(*[F.col(c).cast("double") for c in names])
    state = start.select("symbol", F.col("date").alias("last_date"), values.alias("x"), "_past").join(final, "symbol")

    def path(row: dict) -> list[float]:
        model = Ensemble.read(row["ensemble"])
        x, past, out = np.array(row["x"], float), list(row["_past"]), []
        for _ in range(n_days):
            value = float(model.predict(x[None, :])[0])
            out.append(value)
            if mode == SLOT_SHIFT:
                past = [value, *past][: len(lags)]
                x[places] = past
            else:
                between = [value + (past[0] - value) * (i / stride) for i in range(1, stride)]
                past = [value, *between, *past][: max(distances) + 1]
                # Before enough closes are known a lag has no value; it leads to the right like any NaN.
                x[places] = [past[d] if d < len(past) else np.nan for d in distances]
        return out

    def run(batches):
        for batch in batches:
            kept = batch.select(["symbol", "model", "last_date"])
            steps = pa.array([path(row) for row in batch.to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, steps], ["symbol", "model", "last_date", "path"])

    walked = state.mapInArrow(run, "symbol string, model string, last_date date, path array<double>")
    rows = walked.select("symbol", "model", "last_date", F.posexplode("path").alias("_i", "yhat"))
    return rows.select("symbol", "model", "last_date", (F.col("_i") + 1).alias("step"), "yhat")


def forecast_pipeline(
    start: DataFrame,
    model: PipelineModel,
    name: str,
    names: list[str],
    n_days: int,
    mode: str = HISTORY,
    stride: int = 1,
) -> DataFrame:
    """Forecast of any Spark ML model: one row per symbol goes through the model once per step."""
    lags = lag_columns(names)
    shared_folder(start.sparkSession)
    state = start.withColumn("_out", F.expr("cast(array() AS array<double>)"))
    keep = ["symbol", "date", *names, "_past", "_out"]
    for i in range(1, n_days + 1):
        scored = model.transform(state)
        value = F.col("prediction")
        refreshed = {
            "_past": _next_lags(mode, lags, F.col("_past"), value, stride),
            "_out": F.concat("_out", F.array(value)),
        }
        state = scored.withColumns(refreshed)
        moved = {c: _lag_value(mode, lags, F.col("_past"), c) for c in lags}
        state = state.withColumns(moved).select(*keep)
        if i % CHECKPOINT_EVERY == 0:
            state = state.checkpoint()
    rows = state.select(
        "symbol", F.col("date").alias("last_date"), F.posexplode("_out").alias("_i", "yhat")
    )
    return rows.select(
        "symbol", F.lit(name).alias("model"), "last_date", (F.col("_i") + 1).alias("step"), "yhat"
    )


def dated(forecast: DataFrame, n_days: int, stride: int = 1) -> DataFrame:
    """Put the steps on every ``stride``-th weekday after the last row of each symbol."""
    days = business_days(forecast.select("symbol", "last_date").distinct(), n_days * stride)
    days = days.filter(F.col("step") % stride == 0).withColumn("step", (F.col("step") / stride).cast("int"))
    return forecast.join(days, ["symbol", "step"]).select(
        "symbol", "model", "step", "date", "yhat"
    )


def with_band(forecast: DataFrame, sigma: DataFrame, width: float = 1.5) -> DataFrame:
    """Band of ``width`` residual deviations around the forecast."""
    reach = F.col("sigma") * width
    return forecast.join(sigma, ["symbol", "model"], "left").withColumns(
        {"lower": F.col("yhat") - reach, "upper": F.col("yhat") + reach}
    ).drop("sigma")
