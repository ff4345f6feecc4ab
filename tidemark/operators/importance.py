"""Reports over a table of feature importances (symbol, model, feature, importance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed import FEATURE_GROUPS

_MODEL = ("symbol", "model")


def _by_importance(keys):
    return Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature")


def top_features(importances: DataFrame, top: int = 20, keys=_MODEL) -> DataFrame:
    """The most important features of each model."""
    ranked = importances.withColumn("rank", F.row_number().over(_by_importance(keys)))
    return ranked.filter(F.col("rank") <= top)


def relative_importance(importances: DataFrame, keys=_MODEL) -> DataFrame:
    """Importance in percent of the largest of the model; a largest of zero counts as one."""
    largest = F.max("importance").over(Window.partitionBy(*keys))
    largest = F.when(largest == 0, 1.0).otherwise(largest)
    return importances.withColumn("relative", F.col("importance") / largest * 100)


def group_of(feature: str = "feature"):
    """Names of all groups that one of whose name parts occurs in the feature."""
    hits = [
        F.when(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.col(feature), p)), F.lit(g))
        for g, parts in FEATURE_GROUPS.items()
    ]
    return F.array_compact(F.array(*hits))


def group_importance(importances: DataFrame, keys=_MODEL) -> DataFrame:
    """Total importance of each feature group; a feature counts once per group it belongs to."""
    member = importances.withColumn("feature_group", F.explode(group_of()))
    found = member.groupBy(*keys, "feature_group").agg(F.sum("importance").alias("total"))
    groups = F.explode(F.array(*map(F.lit, FEATURE_GROUPS))).alias("feature_group")
    grid = importances.select(*keys).distinct().select(*keys, groups)
    joined = grid.join(found, [*keys, "feature_group"], "left")
    return joined.withColumn("total", F.coalesce("total", F.lit(0.0)))


def cumulative_importance(importances: DataFrame, keys=_MODEL) -> DataFrame:
    """Share of the total that the most important features reach together, in percent."""
    order = _by_importance(keys)
    total = F.sum("importance").over(Window.partitionBy(*keys))
    running = F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return importances.select(
        *keys,
        "feature",
        F.row_number().over(order).alias("rank"),
        (F.try_divide(running, total) * 100).alias("cumulative"),
    )


def features_to_reach(cumulative: DataFrame, percent: float = 80.0, keys=_MODEL) -> DataFrame:
    """How many features it takes to reach the given percent of all importance."""
    below = F.count_if(F.col("cumulative") < percent) + 1
    return cumulative.groupBy(*keys).agg(below.alias("n_features"))


def model_comparison(importances: DataFrame, per_model: int = 10, top: int = 15) -> DataFrame:
    """A dense model x feature table over the union of each model's best features.

    The union is cut to ``top`` features by their largest importance in any model.
    """
    best = top_features(importances, per_model)
    union = best.groupBy("symbol", "feature").agg(F.max("importance").alias("importance"))
    chosen = top_features(union, top, keys=("symbol",)).select("symbol", "feature")
    models = importances.select("symbol", "model").distinct()
    # One row per symbol, model and chosen feature: bounded by models x ``top``.
    grid = chosen.join(models, "symbol")
    joined = grid.join(importances, ["symbol", "model", "feature"], "left")
    return joined.select(
        "symbol", "model", "feature", F.coalesce("importance", F.lit(0.0)).alias("importance")
    )
