"""Least squares and ridge regression of many groups at once.

Each task reduces its rows of a (group, segment, year) to the triangular factor of a QR decomposition, which
has as many rows as columns.  Factors are merged by stacking and reducing again, by year first, and a
group's models - one per validation fold and the final one - are solved from these small factors.  No task
sees all rows of a group, and unlike with cross products the condition of the features is not squared.

Features that depend linearly on others leave the weights of least squares undetermined.  They are spread
over dependent features evenly (the solution of least norm), or with ``drop_collinear`` features that add
nothing to those before them get no weight and are named in ``dropped``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import LINEAR, RIDGE
from tidemark.plans.evaluation import FOLDS

RIDGE_ALPHA = 1.0
FINAL = -1
# Directions whose singular value is below this share of the largest are linear dependencies.
DEPENDENT = 1e-13
# A scaled feature adds nothing if less than this share of it lies outside the features kept before it.
COLLINEAR = 1e-6
# Factors that a task holds before it passes them on.
HELD_FACTORS = 64

MODEL_SCHEMA = (
    "grp string, model string, fold int, n_train long, intercept double, beta array<double>, "
    "center array<double>, scale array<double>, weights array<double>, dropped array<string>"
)


def _reduced(rows: np.ndarray) -> np.ndarray:
    """Triangular factor of the rows, filled up with zero rows to a square."""
    factor = np.linalg.qr(rows, mode="r")
    missing = rows.shape[1] - len(factor)
    return np.vstack([factor, np.zeros((missing, rows.shape[1]))]) if missing > 0 else factor


def _stacked(factors, size: int) -> np.ndarray:
    return np.vstack([np.asarray(f, dtype=float).reshape(size, size) for f in factors])


def _task_factors(names: list[str], target: str):
    """Per task: the factor of (1, features, label) of each (group, segment)."""
    columns = [*names, target]

    def frame(held):
        return pd.DataFrame(
            {
                "grp": [k[0] for k in held],
                "segment": [k[1] for k in held],
                "year": [k[2] for k in held],
                "factor": [f.ravel() for f in held.values()],
            }
        )

    def run(batches):
        held: dict = {}
        for batch in batches:
            values = batch[columns].to_numpy(dtype=float)
            values = np.column_stack([np.ones(len(values)), values])
            for key, places in batch.groupby(["grp", "segment", "year"]).indices.items():
                part = values[places]
                held[key] = _reduced(np.vstack([held[key], part]) if key in held else part)
            if len(held) > HELD_FACTORS:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    return run


def _merged(size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        factor = _reduced(_stacked(rows["factor"], size))
        out = rows[["grp", "segment", "year"]].head(1).reset_index(drop=True)
        return out.assign(factor=[factor.ravel()])

    return run


def _independent(scaled: np.ndarray) -> np.ndarray:
    """Which columns add something to the kept ones before them, by orthogonalisation in the order given."""
    kept = np.zeros(scaled.shape[1], bool)
    basis = np.zeros((0, len(scaled)))
    for j, column in enumerate(scaled.T):
        size, rest = np.linalg.norm(column), column
        for _ in range(2):
            rest = rest - basis.T @ (basis @ rest)
        if np.linalg.norm(rest) > COLLINEAR * size:
            kept[j] = True
            basis = np.vstack([basis, rest / np.linalg.norm(rest)])
    return kept


def _solved(width: int, folds: int, alphas: dict[str, float], names: list[str], drop_collinear: bool):
    """All models of one group from its factors.

    With a first column of ones the factor below its first row is that of the centred data.
    """
    size = width + 2

    def fit(factor, alpha):
        n = factor[0, 0] ** 2
        mean = factor[0, 1:] / factor[0, 0]
        centred = factor[1:, 1:-1]
        toward = factor[1:, -1]
        scale = np.sqrt((centred**2).sum(0) / n)
        flat = scale <= 1e-12 * np.maximum(1.0, np.abs(mean[:-1]))
        scale = np.where(flat, 1.0, scale)
        scaled = np.where(flat, 0.0, centred / scale)
        used = _independent(scaled) if drop_collinear else np.ones(width, bool)
        left, strength, right = np.linalg.svd(scaled[:, used], full_matrices=False)
        kept = strength > DEPENDENT * max(strength.max(initial=0.0), 1e-300)
        shrink = strength[kept] / (strength[kept] ** 2 + alpha)
        weights = np.zeros(width)
        weights[used] = right[kept].T @ (shrink * (left.T @ toward)[kept])
        beta = weights / scale
        dropped = [c for c, u in zip(names, used) if not u]
        return round(n), mean[-1] - beta @ mean[:-1], dropped, beta, mean[:-1], scale, weights

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for fold in [FINAL, *range(folds)]:
            used = rows[rows["segment"] <= (folds if fold == FINAL else fold)]
            used = used.sort_values(["segment", "year"])
            if used.empty:
                continue
            factor = _reduced(_stacked(used["factor"], size))
            for model, alpha in alphas.items():
                n, intercept, dropped, *vectors = fit(factor, alpha)
                row = [rows["grp"].iloc[0], model, fold, int(n), intercept]
                out.append([*row, *[v.tolist() for v in vectors], dropped])
        columns = ["grp", "model", "fold", "n_train", "intercept", "beta", "center", "scale", "weights"]
        return pd.DataFrame(out, columns=[*columns, "dropped"])

    return run


def fit_linear(
    segmented: DataFrame,
    names: list[str],
    target: str = "Target",
    group: str = "symbol",
    folds: int = FOLDS,
    alpha: float = RIDGE_ALPHA,
    drop_collinear: bool = False,
) -> DataFrame:
    """Fit both linear models for every group and fold; fold -1 is the model of all training rows.

    ``weights`` belong to features scaled to unit deviation, ``beta`` and ``intercept`` to raw ones.
    """
    rows = segmented.filter(F.col("segment") <= folds)
    rows = rows.select(F.col(group).alias("grp"), "segment", F.year("date").alias("year"), *names, target)
    schema = "grp string, segment int, year int, factor array<double>"
    partial = rows.mapInPandas(_task_factors(names, target), schema)
    merged = partial.groupBy("grp", "segment", "year").applyInPandas(_merged(len(names) + 2), schema)
    solve = _solved(len(names), folds, {LINEAR: 0.0, RIDGE: alpha}, names, drop_collinear)
    return merged.groupBy("grp").applyInPandas(solve, MODEL_SCHEMA)


def linear_value(names: list[str], model: str = "m"):
    """Prediction of a joined model row as one column expression."""
    terms = [F.col(c) * F.col(f"{model}.beta")[i] for i, c in enumerate(names)]
    total = F.col(f"{model}.intercept")
    for term in terms:
        total = total + term
    return total


def predict_linear(
    segmented: DataFrame, models: DataFrame, names: list[str], group: str = "symbol"
) -> DataFrame:
    """Predictions of the final models on all rows, and of the fold models on their validation rows.

    The models of one group form one row; the size of that table decides how the join runs, and a
    group with very many rows is split by the adaptive skew join.
    """
    packed = models.groupBy(F.col("grp").alias(group)).agg(
        F.collect_list(F.struct("model", "fold", "intercept", "beta")).alias("_models")
    )
    usable = F.filter(
        "_models", lambda m: (m["fold"] == FINAL) | (m["fold"] == F.col("segment") - 1)
    )
    rows = segmented.join(packed, group).select(
        "symbol", "date", "split", "segment", F.col("Target").alias("y"), *names,
        F.explode(usable).alias("m"),
    )
    return rows.select(
        "symbol",
        "date",
        F.col("m.model").alias("model"),
        F.col("m.fold").alias("fold"),
        "split",
        "y",
        linear_value(names).alias("yhat"),
    )


def linear_importances(models: DataFrame, names: list[str]) -> DataFrame:
    """Absolute weight of every scaled feature in the final models."""
    final = models.filter(F.col("fold") == FINAL)
    named = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("weights"))
    return final.select(F.col("grp").alias("symbol"), "model", F.inline(named)).select(
        "symbol", "model", "feature", F.abs("weights").alias("importance")
    )


def linear_base(models: DataFrame) -> DataFrame:
    """Expected prediction of each linear model: its value at the training means."""
    products = F.zip_with("beta", "center", lambda b, c: b * c)
    at_mean = F.aggregate(products, F.col("intercept"), lambda total, v: total + v)
    final = models.filter(F.col("fold") == FINAL)
    return final.select(F.col("grp").alias("symbol"), "model", at_mean.alias("expected"))
