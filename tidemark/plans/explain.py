"""Shapley values of predictions and the reports made from them.

All explainers return long tables (symbol, date, model, feature, shap, feature_value).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed import SEED
from tidemark.plans.evaluation import first_rows
from tidemark.plans.linear import FINAL
from tidemark.plans.training import LINEAR_MODELS, Training
from tidemark.plans.trees import Ensemble
from tidemark.series import by_year
from tidemark.session import shared_folder
from tidemark.sources.sinks import staged

BACKGROUND_ROWS = 100
ROWS_AT_ONCE = 64


# ---- linear models ------------------------------------------------------------------------------


def linear_shap(rows: DataFrame, models: DataFrame, names: list[str]) -> DataFrame:
    """Exact values of linear models: weight times distance from the training mean."""
    final = models.filter(F.col("fold") == FINAL).select(
        F.col("grp").alias("symbol"), "model", "beta", "center"
    )
    terms = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (F.col("beta")[i] * (F.col(c) - F.col("center")[i])).alias("shap"),
                F.col(c).cast("double").alias("feature_value"),
            )
            for i, c in enumerate(names)
        ]
    )
    return rows.join(final, "symbol").select("symbol", "date", "model", F.inline(terms))


# ---- tree models --------------------------------------------------------------------------------


class Leaves:
    """Leaves of a tree ensemble as arrays: value, and per feature of the path its interval and the
    share of training rows that passes the splits on it.  Unused places are neutral."""

    def __init__(self, value, feature, low, high, share):
        self.value, self.feature = value, feature
        self.low, self.high, self.share = low, high, share

    @property
    def expected(self) -> float:
        return float((self.value * self.share.prod(1)).sum())


def tree_leaves(model, spark) -> Leaves:
    """Read the leaves of a fitted forest or boosted ensemble.

    The ensemble is saved to the shared folder and its node table read back; its size is set by the
    number and depth of the trees, not by the data.
    """
    import uuid

    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID",
        node["id"].alias("id"),
        node["prediction"].alias("value"),
        node["rawCount"].alias("n"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
    )
    weights = list(model.treeWeights)
    if isinstance(model, RandomForestRegressionModel):
        weights = [1.0 / len(weights)] * len(weights)
    values, paths = [], []
    for tree, table in nodes.toPandas().groupby("treeID"):
        for row in _tree_paths(table.set_index("id").to_dict("index")):
            values.append(row[0] * weights[tree])
            paths.append(row[1])
    return _leaves(values, paths)


def ensemble_leaves(model: Ensemble) -> Leaves:
    """The leaves of an ensemble in flat arrays."""
    values, paths = [], []
    for feature, threshold, value, cover in zip(model.feature, model.threshold, model.value, model.cover):
        rows = {
            i: {
                "left": 2 * i + 1 if feature[i] >= 0 else -1,
                "right": 2 * i + 2,
                "feature": int(feature[i]),
                "threshold": threshold[i],
                "value": value[i],
                "n": cover[i],
            }
            for i in np.flatnonzero((cover > 0) | (feature >= 0)).tolist()
        }
        for leaf_value, path in _tree_paths(rows):
            values.append(leaf_value)
            paths.append(path)
    return _leaves(values, paths)


def _tree_paths(rows: dict):
    """Value of each leaf, and per feature of its path the interval and the share of rows that passes."""
    pending = [(0, {})]
    while pending:
        at, path_so_far = pending.pop()
        row = rows[at]
        if row["left"] < 0:
            yield row["value"], path_so_far
            continue
        f, cut = row["feature"], row["threshold"]
        low, high, share = path_so_far.get(f, (-np.inf, np.inf, 1.0))
        for child, interval in (
            (row["left"], (low, min(high, cut))),
            (row["right"], (max(low, cut), high)),
        ):
            passed = share * rows[child]["n"] / row["n"]
            pending.append((child, {**path_so_far, f: (*interval, passed)}))


def _leaves(values: list[float], paths: list[dict]) -> Leaves:
    depth = max(1, max(len(p) for p in paths))
    shape = (len(paths), depth)
    feature = np.zeros(shape, dtype=int)
    low, high, share = np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
    for i, leaf in enumerate(paths):
        for j, (f, (a, b, passed)) in enumerate(leaf.items()):
            feature[i, j], low[i, j], high[i, j], share[i, j] = f, a, b, passed
    return Leaves(np.array(values), feature, low, high, share)


def leaf_values(leaves: Leaves, x: np.ndarray) -> np.ndarray:
    """Shapley values of the rows of ``x`` under path-dependent expectations.

    A leaf with value v is reached when all its intervals hold; leaving a feature out replaces "holds"
    by the share of rows that pass.  Averaging over all orders of the features of the path gives
    v * (holds_i - share_i) * integral over t of the product over the other features of
    (holds * t + share * (1 - t)), a polynomial that Gauss-Legendre nodes integrate exactly.
    """
    depth = leaves.feature.shape[1]
    nodes, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
    nodes, weights = (nodes + 1) / 2, weights / 2
    picked = x[:, leaves.feature]
    holds = ((picked > leaves.low) & (picked <= leaves.high)).astype(float)
    inner = np.zeros_like(holds)
    for t, w in zip(nodes, weights):
        factor = holds * t + leaves.share * (1 - t)
        inner += w * factor.prod(2, keepdims=True) / factor
    parts = leaves.value[:, None] * (holds - leaves.share) * inner
    out = np.zeros((x.shape[1], len(x)))
    np.add.at(out, leaves.feature.ravel(), parts.reshape(len(x), -1).T)
    return out.T


def tree_shap(rows: DataFrame, model, name: str, names: list[str]) -> DataFrame:
    """Exact values of a tree ensemble; the leaves travel to the tasks once."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(tree_leaves(model, spark))

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[start : start + ROWS_AT_ONCE]
                x = part[names].to_numpy(dtype=float)
                values = leaf_values(shared.value, x)
                yield pd.DataFrame(
                    {
                        "symbol": np.repeat(part["symbol"].to_numpy(), len(names)),
                        "date": np.repeat(part["date"].to_numpy(), len(names)),
                        "model": name,
                        "feature": np.tile(names, len(part)),
                        "shap": values.ravel(),
                        "feature_value": x.ravel(),
                    }
                )

    return rows.select("symbol", "date", *names).mapInPandas(
        run,
        "symbol string, date date, model string, feature string, shap double, feature_value double",
    )


def ensemble_shap(rows: DataFrame, models: DataFrame, names: list[str]) -> DataFrame:
    """Exact values of the final tree ensembles of ``plans.trees`` for the rows of their symbols.

    The work is dealt by year of a symbol, which bounds the rows that meet a symbol's models.
    """
    rows = by_year(rows.select("symbol", "date", *names))
    years = rows.groupBy("symbol").agg(F.collect_set("_year").alias("_years"))
    final = models.filter(F.col("fold") == FINAL).select("symbol", "model", "ensemble")
    final = final.join(years, "symbol").withColumn("_in", F.explode("_years")).drop("_years")

    def run(left, right):
        x = left[names].to_numpy(dtype=float)
        out = []
        for name, data in zip(right["model"], right["ensemble"]):
            leaves = ensemble_leaves(Ensemble.read(data))
            values = [leaf_values(leaves, x[i : i + ROWS_AT_ONCE]) for i in range(0, len(x), ROWS_AT_ONCE)]
            if values:
                out.append(
                    pd.DataFrame(
                        {
                            "symbol": np.repeat(left["symbol"].to_numpy(), len(names)),
                            "date": np.repeat(left["date"].to_numpy(), len(names)),
                            "model": name,
                            "feature": np.tile(names, len(left)),
                            "shap": np.concatenate(values).ravel(),
                            "feature_value": x.ravel(),
                        }
                    )
                )
        columns = ["symbol", "date", "model", "feature", "shap", "feature_value"]
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    grouped = rows.groupBy("symbol", "_year").cogroup(final.groupBy("symbol", "_in"))
    return grouped.applyInPandas(
        run,
        "symbol string, date date, model string, feature string, shap double, feature_value double",
    )


# ---- any model ----------------------------------------------------------------------------------


def background_rows(train: DataFrame, names: list[str], count: int = BACKGROUND_ROWS, seed: int = SEED):
    """A sample of training rows of each symbol, numbered from 0: the rows with the smallest hashes."""
    draw = F.xxhash64(F.lit(seed), "symbol", "date").alias("draw")
    values = F.array(*[F.col(c).cast("double") for c in names]).alias("base")
    smallest = F.array_sort(F.collect_list(F.struct(draw, values)))
    yearly = train.groupBy("symbol", F.year("date").alias("_year")).agg(
        F.slice(smallest, 1, count).alias("picks")
    )
    picks = F.slice(F.array_sort(F.flatten(F.collect_list("picks"))), 1, count)
    chosen = yearly.groupBy("symbol").agg(picks.alias("picks"))
    rows = chosen.select("symbol", F.size("picks").alias("n_base"), F.posexplode("picks").alias("i", "p"))
    return rows.select("symbol", "n_base", "i", "p.base")


def sampled_shap(
    rows: DataFrame,
    background: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    name: str,
    names: list[str],
    permutations: int = 20,
    seed: int = SEED,
    tolerance: float | None = None,
    rounds: int = 1,
) -> DataFrame:
    """Values of any model by sampled orders of the features, with a standard error.

    Per row and order the features move one by one from a background row to the explained row; the
    change of the prediction at a feature's turn is one sample of its value.  Every order is walked
    forward and backward and the two samples are averaged, which is exact for effects of pairs of
    features.  ``error`` is the standard error over the averages, NULL for a single one.  A round has
    ``permutations`` orders; with a ``tolerance`` up to ``rounds`` rounds follow for rows of which some
    feature has a larger error.  ``score`` adds a ``prediction`` to rows with a ``features`` vector.
    """
    out, waiting = None, rows.select("symbol", "date", *names)
    for i in range(rounds if tolerance is not None else 1):
        sums = _walked(waiting, background, score, names, i * permutations, permutations, seed)
        if out is not None:
            keys = ["symbol", "date", "feature"]
            old = out.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "total", "squares")])
            sums = out.join(sums.select(*keys), keys, "left_anti").unionByName(
                sums.join(old, keys).select(
                    *keys, "value", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("n", "total", "squares")]
                )
            )
        if tolerance is None:
            out = sums
            break
        out = staged(sums, "sampled-values")
        large = out.filter(_standard_error() > tolerance).select("symbol", "date").distinct()
        if i + 1 == rounds or large.isEmpty():
            break
        waiting = rows.join(large, ["symbol", "date"], "left_semi").select("symbol", "date", *names)
    return out.select(
        "symbol",
        "date",
        F.lit(name).alias("model"),
        "feature",
        (F.col("total") / F.col("n")).alias("shap"),
        F.col("value").alias("feature_value"),
        _standard_error().alias("error"),
    )


def _standard_error():
    spread = F.greatest(F.col("squares") - F.col("total") * F.col("total") / F.col("n"), F.lit(0.0))
    return F.sqrt(F.try_divide(spread, F.col("n") * (F.col("n") - 1)))


def _walked(rows, background, score, names: list[str], first: int, count: int, seed: int) -> DataFrame:
    """Number, sum and sum of squares of the samples of some orders, each the mean of its two directions."""
    d = len(names)
    orders = F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))).alias("order")
    walks = rows.select(
        "symbol", "date", F.array(*[F.col(c).cast("double") for c in names]).alias("x"), orders
    )
    turn = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(d - 1)),
            lambda i: F.struct(
                F.xxhash64(F.lit(seed), "symbol", "date", "order", i).alias("h"), i.alias("i")
            ),
        )
    )
    walks = walks.withColumn("turn", F.transform(turn, lambda e: e["i"]))
    both = F.array(
        F.struct(F.lit(0).alias("back"), F.col("turn")), F.struct(F.lit(1).alias("back"), F.reverse("turn").alias("turn"))
    )
    walks = walks.select("symbol", "date", "x", "order", F.inline(both))
    places = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.array_position(F.col("turn"), i) - 1
    )
    walks = walks.withColumn("place", places)
    base = background.select("symbol", F.col("i").alias("_i"), "base")
    sizes = background.select("symbol", "n_base").distinct()
    # The orders of a row take different background rows, beginning at a place of the row's own.
    begin = F.pmod(F.xxhash64(F.lit(seed), F.lit("base"), "symbol", "date"), F.col("n_base"))
    drawn = (begin + F.col("order")) % F.col("n_base")
    walks = walks.join(sizes, "symbol").withColumn("_i", drawn.cast("int"))
    walks = walks.join(base, ["symbol", "_i"])
    steps = walks.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = F.transform(
        "x", lambda v, i: F.when(F.get("place", i) < F.col("step"), v).otherwise(F.get("base", i))
    )
    scored = score(steps.withColumn("features", array_to_vector(mixed)))
    walk = Window.partitionBy("symbol", "date", "order", "back").orderBy("step")
    moved = scored.withColumn("gain", F.col("prediction") - F.lag("prediction").over(walk))
    moved = moved.filter(F.col("step") > 0)
    place = F.element_at("turn", F.col("step"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), place + 1)
    gains = moved.select(
        "symbol", "date", "order", label.alias("feature"), F.element_at("x", place + 1).alias("value"), "gain"
    )
    pairs = gains.groupBy("symbol", "date", "feature", "order").agg(F.avg("gain").alias("gain"), F.first("value").alias("value"))
    return pairs.groupBy("symbol", "date", "feature").agg(
        F.first("value").alias("value"),
        F.count(F.lit(1)).alias("n"),
        F.sum("gain").alias("total"),
        F.sum(F.col("gain") * F.col("gain")).alias("squares"),
    )


# ---- choice of the explainer and reports ----------------------------------------------------------


def explain_rows(
    training: Training,
    model: str,
    rows: DataFrame,
    background: int = BACKGROUND_ROWS,
    permutations: int = 20,
    tolerance: float | None = None,
    rounds: int = 1,
) -> DataFrame:
    """Values of one trained model for the given feature rows, by the explainer that fits the model.

    The last four arguments are those of the sampled explainer, which serves models of other kinds.
    """
    if model in LINEAR_MODELS:
        models = training.linear.filter(F.col("model") == model)
        return linear_shap(rows, models, training.names)
    if training.trees is not None:
        own = training.trees.filter(F.col("model") == model)
        return ensemble_shap(rows, own, training.names)
    parts = []
    for (group, name), pipeline in training.fitted.items():
        if name != model:
            continue
        served = rows if group == "*" else rows.filter(F.col("symbol") == group)
        fitted = pipeline.stages[-1]
        if isinstance(fitted, (RandomForestRegressionModel, GBTRegressionModel)):
            parts.append(tree_shap(served, fitted, name, training.names))
        else:
            train = training.features.filter(F.col("split") == "train")
            base = background_rows(train, training.names, background)
            shap = sampled_shap(
                served, base, fitted.transform, name, training.names, permutations, tolerance=tolerance, rounds=rounds
            )
            parts.append(shap.drop("error"))
    if not parts:
        raise ValueError(f"not trained: {model}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def global_importance(shap: DataFrame, top: int = 20) -> DataFrame:
    """Mean absolute value of every feature, the ``top`` largest per symbol and model."""
    means = shap.groupBy("symbol", "model", "feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap")
    )
    order = Window.partitionBy("symbol", "model").orderBy(F.col("mean_abs_shap").desc(), "feature")
    return means.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def local_explanation(shap: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` strongest features of every explained row with their direction."""
    strength = F.abs("shap").desc()
    order = Window.partitionBy("symbol", "model", "date").orderBy(strength, "feature")
    ranked = shap.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.withColumn(
        "direction", F.when(F.col("shap") >= 0, "positive").otherwise("negative")
    )


def regime_summary(shap: DataFrame, regimes: DataFrame) -> DataFrame:
    """Mean and mean absolute value of every feature in each regime."""
    joined = shap.join(regimes.select("symbol", "date", "regime"), ["symbol", "date"])
    return joined.groupBy("symbol", "model", "regime", "feature").agg(
        F.avg("shap").alias("mean_shap"), F.avg(F.abs("shap")).alias("mean_abs_shap")
    )


def explained_rows(training: Training, count: int | None = None) -> DataFrame:
    """All test rows, or the first ``count`` of every symbol."""
    rows = training.features.filter(F.col("split") == "test")
    return rows if count is None else first_rows(rows, count)


def run_explanation(
    training: Training, model: str | None = None, count: int | None = None
) -> dict[str, DataFrame]:
    """Shapley values of the test rows (all, or the first ``count`` per symbol) and their ranking.

    Without a model name each symbol is explained with its own best model.
    """
    rows = explained_rows(training, count)
    if model is not None:
        shap = explain_rows(training, model, rows)
    else:
        best = training.best().select("symbol", "model")
        names = {r["model"] for r in best.select("model").distinct().collect()}
        shap = None
        for name in sorted(names):
            part = explain_rows(training, name, rows)
            part = part.join(best, ["symbol", "model"], "left_semi")
            shap = part if shap is None else shap.unionByName(part)
    tables = {"shap": shap, "global_importance": global_importance(shap)}
    if training.linear is not None or training.trees is not None:
        tables["expected"] = training.expected().join(shap.select("symbol", "model").distinct(), ["symbol", "model"], "left_semi")
    return tables
