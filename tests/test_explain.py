"""Tree values against a brute-force Shapley sum over all feature subsets, and additivity."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.plans.explain import background_rows, leaf_values, sampled_shap, tree_leaves, tree_shap

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 4)).round(3)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 2.0, -1.0) * x[:, 2] + 0.1 * rng.normal(size=240)
    rows = [
        ("S", f"2020-{1 + i % 12:02d}-{1 + i // 12:02d}", *map(float, x[i]), float(y[i]))
        for i in range(240)
    ]
    df = spark.createDataFrame(rows, ["symbol", "date", *NAMES, "Target"])
    df = df.withColumn("date", F.col("date").cast("date"))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


def conditional(leaves, x, known):
    """Prediction with unknown features averaged by the shares of training rows."""
    total = 0.0
    for value, feature, low, high, share in zip(
        leaves.value, leaves.feature, leaves.low, leaves.high, leaves.share
    ):
        weight = 1.0
        for f, a, b, s in zip(feature, low, high, share):
            if np.isinf(a) and np.isinf(b):
                continue
            weight *= (a < x[f] <= b) if f in known else s
        total += value * weight
    return total


def brute_force(leaves, x):
    d = len(x)
    out = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            weight = factorial(size) * factorial(d - size - 1) / factorial(d)
            for s in combinations(others, size):
                gain = conditional(leaves, x, {*s, i}) - conditional(leaves, x, set(s))
                out[i] += weight * gain
    return out


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_tree_values(spark, data, kind):
    shared = {"labelCol": "Target", "maxDepth": 4, "seed": 1}
    estimator = (
        RandomForestRegressor(numTrees=5, **shared)
        if kind == "forest"
        else GBTRegressor(maxIter=4, stepSize=0.3, **shared)
    )
    model = estimator.fit(data)
    leaves = tree_leaves(model, spark)
    rows = data.limit(6)
    table = rows.toPandas()
    x = table[NAMES].to_numpy(dtype=float)
    values = leaf_values(leaves, x)
    for i in range(3):
        assert np.allclose(values[i], brute_force(leaves, x[i]), atol=1e-9)
    predicted = model.transform(rows).toPandas()["prediction"].to_numpy()
    assert np.allclose(values.sum(1) + leaves.expected, predicted, atol=1e-8)
    long = tree_shap(rows, model, "m", NAMES).toPandas()
    assert np.isclose(long["shap"].sum(), values.sum())
    assert len(long) == 6 * 4


def test_sampled_values_of_a_linear_model(spark, data):
    model = LinearRegression(labelCol="Target").fit(data)
    rows = data.limit(4)
    base = background_rows(data, NAMES, count=20)
    shap = sampled_shap(rows, base, model.transform, "m", NAMES, permutations=20).toPandas()
    mean = np.array([r["base"] for r in base.collect()], dtype=float).mean(0)
    for row in rows.collect():
        own = shap[shap["date"] == row["date"]].set_index("feature")["shap"]
        for i, c in enumerate(NAMES):
            # Every background row is used once, so the linear case is exact.
            assert np.isclose(own[c], model.coefficients[i] * (row[c] - mean[i]), atol=1e-9)


def test_sampled_values_report_their_error(spark, data):
    """Pairs of opposite orders are exact for pairs of features; products of three need rounds."""
    rows = data.limit(3)
    base = background_rows(data, NAMES, count=1)
    b = base.first()["base"]

    def score(table):
        x = vector_to_array("features")
        return table.withColumn("prediction", x[0] * x[1] + x[1] * x[2] * x[3])

    keys = {r["date"]: r for r in rows.collect()}
    one = sampled_shap(rows.filter("a > -99"), base, score, "m", NAMES, permutations=6).toPandas()
    assert (one["error"] >= 0).all() and one["error"].max() > 0
    assert np.allclose(one[one["feature"] == "a"]["error"], 0, atol=1e-6)
    wide = one["error"].max() / 3
    more = sampled_shap(rows, base, score, "m", NAMES, permutations=6, tolerance=wide, rounds=40).toPandas()
    assert more["error"].max() <= wide
    for _, got in more.iterrows():
        x = [keys[got["date"]][c] for c in NAMES]
        f = lambda known: (lambda v: v[0] * v[1] + v[1] * v[2] * v[3])([x[i] if i in known else b[i] for i in range(4)])
        i = NAMES.index(got["feature"])
        others = [j for j in range(4) if j != i]
        exact = sum(
            factorial(k) * factorial(3 - k) / factorial(4) * (f({*s, i}) - f(set(s))) for k in range(4) for s in combinations(others, k)
        )
        assert abs(got["shap"] - exact) <= 6 * got["error"] + 1e-9
