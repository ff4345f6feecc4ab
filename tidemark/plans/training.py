"""The model registry and training of all models with validation folds and metrics.

The two linear models are fitted for every symbol at once (``plans.linear``), and so are the three tree
models (``plans.trees``), all folds in the same job.  With ``scope="pooled"`` one tree model, a Spark ML
estimator, learns from the training rows of all symbols instead.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import BOOSTING, FOREST, LINEAR, MODEL_NAMES, RIDGE, SEED, XGBOOST
from tidemark.plans import evaluation
from tidemark.plans.evaluation import FOLDS, TEST_SIZE
from tidemark.plans.features import feature_names
from tidemark.plans.linear import FINAL, fit_linear, linear_base, linear_importances, predict_linear
from tidemark.plans.trees import Settings, fit_trees, tree_importances, tree_predictions
from tidemark.sources.sinks import staged

LINEAR_MODELS = (LINEAR, RIDGE)
TREE_MODELS = (FOREST, XGBOOST, BOOSTING)
POOLED = "pooled"
PER_SYMBOL = "symbol"
MAX_BINS = 128


def tree_estimator(model: str):
    """Estimator of one tree model with the registry's settings."""
    shared = {"featuresCol": "features", "labelCol": "Target", "seed": SEED, "maxBins": MAX_BINS}
    if model == FOREST:
        return RandomForestRegressor(
            numTrees=50, maxDepth=8, featureSubsetStrategy="all", **shared
        )
    if model == XGBOOST:
        return GBTRegressor(
            maxIter=100,
            maxDepth=4,
            stepSize=0.05,
            subsamplingRate=0.8,
            featureSubsetStrategy="0.8",
            **shared,
        )
    if model == BOOSTING:
        return GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.05, **shared)
    raise ValueError(f"not a tree model: {model}")


def linear_pipeline(model: str, names: list[str], n: int, label_deviation: float) -> Pipeline:
    """A linear model as a Spark ML pipeline, for callers who want a pipeline of one data set.

    Spark ML divides the penalty by the label deviation and counts rows once; the conversion makes it
    the penalty of one added to the sum of squares.
    """
    penalty = label_deviation / n if model == RIDGE else 0.0
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            LinearRegression(
                labelCol="Target", regParam=penalty, elasticNetParam=0.0, solver="normal"
            ),
        ]
    )


def tree_pipeline(model: str, names: list[str]) -> Pipeline:
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    return Pipeline(stages=[assembler, tree_estimator(model)])


@dataclass
class Training:
    """Everything that training yields, as tables.

    ``linear`` and ``trees`` hold the models of the symbols; ``fitted`` the pooled Spark ML models.
    """

    features: DataFrame
    names: list[str]
    predictions: DataFrame
    fold_predictions: DataFrame | None
    importances: DataFrame
    linear: DataFrame | None = None
    trees: DataFrame | None = None
    fitted: dict[tuple[str, str], PipelineModel] = field(default_factory=dict)

    def metrics(self) -> DataFrame:
        return evaluation.metrics(self.predictions)

    def cv_scores(self) -> DataFrame:
        return evaluation.fold_scores(self.fold_predictions)

    def summary(self) -> DataFrame:
        return evaluation.summary(self.metrics(), self.cv_scores())

    def expected(self) -> DataFrame:
        """Expected prediction of the models of each symbol; Shapley values add up to the distance from it."""
        parts = []
        if self.linear is not None:
            parts.append(linear_base(self.linear))
        if self.trees is not None:
            parts.append(self.trees.filter(F.col("fold") == FINAL).select("symbol", "model", "expected"))
        return _union(parts)

    def best(self) -> DataFrame:
        return evaluation.best_models(self.metrics())

    def best_predictions(self) -> DataFrame:
        return evaluation.best_predictions(self.predictions, self.best())


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _tree_rows(model: PipelineModel, rows: DataFrame, name: str, fold: int) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(
        "symbol",
        "date",
        F.lit(name).alias("model"),
        F.lit(fold).alias("fold"),
        "split",
        F.col("Target").alias("y"),
        F.col("prediction").alias("yhat"),
    )


def _tree_importances(model: PipelineModel, names, name: str, symbols: DataFrame) -> DataFrame:
    """Importances of one model, listed for every symbol that it serves."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.lit(v).alias("importance"))
            for n, v in zip(names, values)
        ]
    )
    return symbols.select("symbol", F.lit(name).alias("model"), F.inline(pairs))


def train_all(
    features: DataFrame,
    models=MODEL_NAMES,
    test_size: float = TEST_SIZE,
    folds: int = FOLDS,
    scope: str = PER_SYMBOL,
    symbols: list[str] | None = None,
    validate: bool = True,
    parallelism: int = 4,
    settings: dict[str, Settings] | None = None,
    drop_collinear: bool = False,
) -> Training:
    """Fit the models on the first rows of each symbol, predict all rows, validate on folds.

    Pooled fits are submitted from ``parallelism`` driver threads; each is a Spark job.  ``settings``
    replaces those of the registry for tree models by symbol; ``drop_collinear`` leaves features that depend
    linearly on others out of the linear models.
    """
    if symbols is not None:
        features = features.filter(F.col("symbol").isin(list(symbols)))
    names = feature_names(features)
    # Stored, because every fit below reads it again.
    rows = staged(evaluation.with_segments(features, test_size, folds), "segments")

    parts, fold_parts, importances, fitted = [], [], [], {}
    linear = None
    wanted = [m for m in models if m in LINEAR_MODELS]
    if wanted:
        linear = fit_linear(rows, names, folds=folds if validate else 0, drop_collinear=drop_collinear)
        linear = staged(linear.filter(F.col("model").isin(wanted)), "linear-models")
        scored = predict_linear(rows, linear, names)
        parts.append(scored.filter(F.col("fold") == FINAL))
        fold_parts.append(scored.filter(F.col("fold") != FINAL))
        importances.append(linear_importances(linear, names))

    trees = [m for m in models if m in TREE_MODELS]
    by_symbol = None
    if trees and scope == PER_SYMBOL:
        by_symbol = staged(fit_trees(rows, names, trees, folds, validate, settings), "tree-models")
        scored = tree_predictions(by_symbol)
        parts.append(scored.filter(F.col("fold") == FINAL))
        fold_parts.append(scored.filter(F.col("fold") != FINAL))
        importances.append(tree_importances(by_symbol, names))
    elif trees:
        tasks = [(m, t) for m in trees for t in [FINAL, *(range(folds) if validate else ())]]

        def fit(task):
            model, fold = task
            last = folds if fold == FINAL else fold
            return tree_pipeline(model, names).fit(rows.filter(F.col("segment") <= last))

        with ThreadPoolExecutor(parallelism) as pool:
            for (model, fold), result in zip(tasks, pool.map(fit, tasks)):
                if fold == FINAL:
                    fitted[("*", model)] = result
                    parts.append(_tree_rows(result, rows, model, FINAL))
                    served = rows.select("symbol").distinct()
                    importances.append(_tree_importances(result, names, model, served))
                else:
                    valid = rows.filter(F.col("segment") == fold + 1)
                    fold_parts.append(_tree_rows(result, valid, model, fold))

    return Training(
        features=rows,
        names=names,
        # Metrics, bands and explanations read them, so every row is scored once.
        predictions=staged(_union(parts), "predictions"),
        fold_predictions=_union(fold_parts) if validate else None,
        importances=_union(importances),
        linear=linear,
        trees=by_symbol,
        fitted=fitted,
    )
