"""Trees against a plain recursion over all cuts, and what their ensembles promise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.fixed import BOOSTING, FOREST, XGBOOST
from tidemark.plans import evaluation, trees
from tidemark.plans.linear import FINAL
from tidemark.plans.trees import Ensemble, Settings, cuts, fitted, grown

NAMES = ["a", "b", "c"]


def binned(x, bins=1 << 15):
    edges = [cuts(column, bins) for column in x.T]
    return np.column_stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)]), edges


def plain_tree(x, g, h, depth, l2):
    """Predictions of a tree that tries every cut between two values."""
    value = -g.sum() / (h.sum() + l2)
    out = np.full(len(x), value)
    if depth == 0 or len(x) < 2:
        return out
    best = (1e-12 * (g**2).sum(), None)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if h[left].sum() == 0 or h[~left].sum() == 0:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + l2)
            if gain > best[0] * (1 + 1e-9):
                best = (gain, left)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[side], g[side], h[side], depth - 1, l2)
    return out


@pytest.mark.parametrize("l2", [0.0, 1.0, 7.5])
def test_tree_against_all_cuts(l2):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=60), rng.integers(0, 4, 60), rng.normal(size=60).round(1)])
    y = np.where(x[:, 0] > 0.3, 4.0, x[:, 2]) + 0.3 * rng.normal(size=60)
    weight = rng.integers(0, 3, 60).astype(float)
    codes, _ = binned(x)
    tree = grown(codes, -y * weight, weight, np.arange(3), Settings(1, 3, l2=l2))
    own = weight > 0
    want = plain_tree(x[own], (-y * weight)[own], weight[own], 3, l2)
    assert np.allclose(tree.value[tree.leaf][own], want)


def test_ensembles_predict_what_training_saw():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5))
    x[:, 4] = 1.0
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 2.0, -1.0) * x[:, 2]
    train = np.arange(300) < 240
    for model, settings in trees.smaller(12, bins=32).items():
        codes, edges = binned(x, 32)
        ensemble, at = fitted(codes, edges, y, train, settings, FINAL)
        again = Ensemble.read(bytes(ensemble))
        assert np.allclose(again.predict(x), at)
        shares = again.importances(model, 5)
        assert shares.sum() == pytest.approx(1) and shares[4] == 0 and shares[0] == shares.max()
        assert ((y - at)[train] ** 2).mean() < ((y - y[train].mean())[train] ** 2).mean()
        same, more = fitted(codes, edges, y, train, settings, FINAL)
        assert (more == at).all()
        if model == XGBOOST:
            assert max(len(np.unique(f[f >= 0])) for f in again.feature) <= 4
    assert trees.SETTINGS[XGBOOST].l2 == 1.0 and trees.SETTINGS[FOREST].depth == 8


def test_first_step_of_boosting_shrinks():
    x = np.arange(10.0)[:, None]
    y = np.where(x[:, 0] > 4, 10.0, 0.0)
    codes, edges = binned(x)
    _, at = fitted(codes, edges, y, np.ones(10, bool), Settings(1, 1, rate=0.05), FINAL)
    assert np.allclose(at, np.where(y > 5, 5.25, 4.75))
    _, at = fitted(codes, edges, y, np.ones(10, bool), Settings(1, 1, rate=0.05, l2=1.0), FINAL)
    assert np.allclose(at, np.where(y > 5, 5 + 0.05 * 25 / 6, 5 - 0.05 * 25 / 6))


def test_folds_do_not_look_ahead(spark):
    rng = np.random.default_rng(7)
    days = [f"20{10 + i // 300:02d}-{1 + i % 300 // 25:02d}-{1 + i % 25:02d}" for i in range(400)]
    x = rng.normal(size=(400, 3)).round(3)
    y = (2 * x[:, 0] - x[:, 1]).round(4)
    rows = [(s, days[i], *map(float, x[i]), float(y[i] * k)) for s, k in (("S", 1), ("T", -3)) for i in range(400)]
    rows.append(("U", days[0], 0.0, 0.0, 0.0, 1.0))
    table = spark.createDataFrame(rows, ["symbol", "date", *NAMES, "Target"]).withColumn("date", F.col("date").cast("date"))
    segmented = evaluation.with_segments(table)
    models = trees.fit_trees(segmented, NAMES, [FOREST, BOOSTING], settings=trees.smaller(4))
    got = {(r["symbol"], r["model"], r["fold"]): r for r in models.collect()}
    # One row alone has nothing to learn from.
    assert len(got) == 2 * 2 * 6
    assert got[("S", FOREST, FINAL)]["n_train"] == 320 and got[("S", FOREST, 0)]["n_train"] == 55
    scored = trees.tree_predictions(models).filter(F.col("fold") >= 0)
    later = scored.join(segmented.select("symbol", "date", "segment"), ["symbol", "date"])
    assert later.filter(F.col("segment") != F.col("fold") + 1).count() == 0 and later.count() == 2 * 2 * 5 * 53
    changed = segmented.withColumn("Target", F.when(F.col("segment") > 2, 1e6).otherwise(F.col("Target")))
    again = trees.fit_trees(changed, NAMES, [FOREST], settings=trees.smaller(4)).filter("fold = 2 and symbol = 'S'").first()
    assert again["ensemble"] == got[("S", FOREST, 2)]["ensemble"]
