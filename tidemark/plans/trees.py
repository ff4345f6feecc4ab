"""Tree ensembles of every symbol, model and fold in one job.

The days of a symbol are bounded by the calendar (a year has 366 at most), so its binned feature matrix is a small
row: one byte or two for each value.  One shuffle makes these rows; they are then dealt out once for each model and fold,
and every copy becomes an ensemble with its predictions.  Boosting would need a pass over the data for each
level of each tree if its histograms were merged between tasks; here the table is read and shuffled once.

Trees grow level by level on sums of gradient and weight by (node, feature, bin).  With squared loss a leaf is worth
-G / (H + l2), and a split gains GL^2/(HL + l2) + GR^2/(HR + l2) - G^2/(H + l2); forests are the case of one step
from the mean with drawn row weights.  Ensembles are flat arrays: node i has the children 2i + 1 and 2i + 2, a
feature of -1 marks a leaf, and rows go left where the value is at most the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import BOOSTING, FOREST, SEED, XGBOOST
from tidemark.plans.evaluation import FOLDS
from tidemark.plans.linear import FINAL

#: Candidate cuts of a feature, at quantiles of its training values; features with fewer different values keep all.
BINS = 128


@dataclass(frozen=True)
class Settings:
    """`rows` and `columns`: shares drawn for each tree; `bootstrap`: rows drawn with replacement, steps averaged."""

    trees: int
    depth: int
    rate: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    l2: float = 0.0
    bootstrap: bool = False
    bins: int = BINS


# Settings of the model registry.
SETTINGS = {
    FOREST: Settings(trees=50, depth=8, bootstrap=True),
    XGBOOST: Settings(trees=100, depth=4, rate=0.05, rows=0.8, columns=0.8, l2=1.0),
    BOOSTING: Settings(trees=100, depth=3, rate=0.05),
}


# ---- one tree -------------------------------------------------------------------------------------------


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    leaf: np.ndarray


def grown(codes: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray, s: Settings) -> Tree:
    """A tree on bin codes (row, feature), gradients and weights of the rows; only features `used` split.

    Rows of weight zero take no part but are led to their leaf.  Ties go to the first feature and the lowest cut.
    """
    n, size = len(g), 2 ** (s.depth + 1) - 1
    out = Tree(np.full(size, -1, np.int16), np.zeros(size, np.int32), np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(n, np.int64))
    own = np.ascontiguousarray(codes[:, used])
    bins = int(own.max(initial=0)) + 1
    live = np.flatnonzero(h > 0)
    scale = 1e-12 * max(float((g * g).sum()), 1e-300)
    for level in range(s.depth + 1):
        first = 2**level - 1
        at = out.leaf[live] - first
        inside = at >= 0
        rows, at = live[inside], at[inside]
        total_g, total_h = np.bincount(at, g[rows], 2**level), np.bincount(at, h[rows], 2**level)
        there = np.flatnonzero(total_h > 0)
        out.value[first + there] = -total_g[there] / (total_h[there] + s.l2)
        out.cover[first + there] = total_h[there]
        count = np.bincount(at, minlength=2**level)
        open_ = np.flatnonzero(count > 1)
        if level == s.depth or not len(open_) or bins < 2:
            break
        number = np.full(2**level, -1)
        number[open_] = np.arange(len(open_))
        kept = number[at] >= 0
        rows, k = rows[kept], number[at[kept]]
        cells = ((k[:, None] * len(used) + np.arange(len(used))) * bins + own[rows]).ravel()
        shape = (len(open_), len(used), bins)
        left_g, left_h = (
            np.bincount(cells, np.repeat(x[rows], len(used)), np.prod(shape)).reshape(shape).cumsum(2)[..., :-1] for x in (g, h)
        )
        all_g, all_h = total_g[open_][:, None, None], total_h[open_][:, None, None]
        right_g, right_h = all_g - left_g, all_h - left_h
        # Sums of drawn weights are whole numbers, so an empty side is exactly zero.
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / (left_h + s.l2) + right_g**2 / (right_h + s.l2) - all_g**2 / (all_h + s.l2)
        gain[(left_h < 0.5) | (right_h < 0.5)] = -np.inf
        flat = gain.reshape(len(open_), -1)
        best = flat.argmax(1)
        won = flat[np.arange(len(open_)), best]
        split = np.flatnonzero(won > scale)
        if not len(split):
            break
        node = first + open_[split]
        out.feature[node] = used[best[split] // (bins - 1)]
        out.cut[node] = best[split] % (bins - 1)
        out.gain[node] = won[split]
        # All rows of the nodes go down, those of weight zero too.
        moving = np.flatnonzero((out.leaf >= first) & (out.feature[out.leaf] >= 0))
        here = out.leaf[moving]
        out.leaf[moving] = 2 * here + 1 + (codes[moving, out.feature[here]] > out.cut[here])
    return out


# ---- one ensemble ---------------------------------------------------------------------------------------


@dataclass
class Ensemble:
    """Trees as flat arrays (tree, node); the prediction is `base` plus the values of the leaves reached."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of `x`, all trees a level at a time."""
        tree = np.arange(len(self.feature))[:, None]
        node = np.zeros((len(self.feature), len(x)), np.int64)
        row = np.arange(len(x))[None, :]
        while True:
            feature = self.feature[tree, node]
            inner = feature >= 0
            if not inner.any():
                break
            right = x[row, np.maximum(feature, 0)] > self.threshold[tree, node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return self.base + self.value[tree, node].sum(0)

    def importances(self, model: str, width: int) -> np.ndarray:
        """Shares of the features in the gain: mean of the trees' shares for forests, mean gain of a split for
        second-order boosting, gain of all trees otherwise."""

        def shares(x):
            return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)

        sums = np.zeros((len(self.feature), width))
        tree, node = np.nonzero(self.feature >= 0)
        place = tree, self.feature[tree, node]
        np.add.at(sums, place, self.gain[tree, node])
        if model == FOREST:
            grown_ = sums.sum(1) > 0
            return shares(sums)[grown_].mean(0) if grown_.any() else np.zeros(width)
        if model == XGBOOST:
            return shares(sums.sum(0) / np.maximum(np.bincount(place[1], minlength=width), 1))
        return shares(sums.sum(0))

    def __bytes__(self) -> bytes:
        head = np.array([*self.feature.shape, 0], np.int64).tobytes() + np.float64(self.base).tobytes()
        return head + self.feature.astype(np.int64).tobytes() + b"".join(
            np.ascontiguousarray(x, np.float64).tobytes() for x in (self.threshold, self.value, self.cover, self.gain)
        )

    @classmethod
    def read(cls, data: bytes) -> Ensemble:
        trees, nodes, _ = np.frombuffer(data, np.int64, 3)
        base = np.frombuffer(data, np.float64, 1, 24)[0]
        feature = np.frombuffer(data, np.int64, trees * nodes, 32).reshape(trees, nodes)
        rest = np.frombuffer(data, np.float64, -1, 32 + 8 * trees * nodes).reshape(4, trees, nodes)
        return cls(float(base), feature, *rest)


def fitted(codes: np.ndarray, edges: list[np.ndarray], y: np.ndarray, train: np.ndarray, s: Settings, fold: int) -> tuple[Ensemble, np.ndarray]:
    """An ensemble on the training rows, and its predictions for all rows."""
    n, width = codes.shape
    base = float(y[train].mean())
    at = np.full(n, base)
    trees: list[Tree] = []
    rate = 1.0 / s.trees if s.bootstrap else s.rate
    for t in range(s.trees):
        draw = np.random.default_rng([SEED, fold + 1, t])
        weight = train.astype(np.float64)
        if s.bootstrap:
            own = np.flatnonzero(train)
            weight = np.bincount(own[draw.integers(len(own), size=len(own))], minlength=n).astype(np.float64)
        elif s.rows < 1:
            weight *= draw.random(n) < s.rows
        used = np.arange(width)
        if s.columns < 1:
            used = np.sort(draw.permutation(width)[: max(1, int(width * s.columns))])
        residual = (base if s.bootstrap else at) - y
        tree = grown(codes, np.where(weight > 0, residual * weight, 0.0), weight, used, s)
        tree.value *= rate
        at = at + tree.value[tree.leaf]
        trees.append(tree)
    stacked = {k: np.stack([getattr(t, k) for t in trees]) for k in ("feature", "cut", "value", "cover", "gain")}
    table = np.full((width, max(1, max(len(e) for e in edges))), np.inf)
    for j, e in enumerate(edges):
        table[j, : len(e)] = e
    feature = stacked["feature"].astype(np.int64)
    threshold = np.where(feature >= 0, table[np.maximum(feature, 0), np.minimum(stacked["cut"], table.shape[1] - 1)], 0.0)
    return Ensemble(base, feature, threshold, stacked["value"], stacked["cover"], stacked["gain"]), at


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of the bins of a feature: middles between neighbouring values, at most bins - 1."""
    distinct = np.unique(values)
    middles = (distinct[:-1] + distinct[1:]) / 2
    # A middle that rounds up to the higher value would lead it to the wrong side.
    middles = np.where(middles < distinct[1:], middles, distinct[:-1])
    if len(middles) < bins:
        return middles
    places = np.searchsorted(middles, np.quantile(values, np.arange(1, bins) / bins))
    return middles[np.unique(np.minimum(places, len(middles) - 1))]


# ---- jobs -----------------------------------------------------------------------------------------------

_BINNED = "symbol string, n int, codes binary, edges binary, dates array<date>, y array<double>, segment array<int>, split array<string>"
_FITTED = (
    "symbol string, model string, fold int, ensemble binary, importance array<double>, expected double, n_train long, "
    "rows array<struct<date:date,split:string,y:double,yhat:double>>"
)


def _binned(names: list[str], folds: int, bins: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("date").combine_chunks()
        x = np.column_stack([table.column(c).cast(pa.float64()).to_numpy() for c in names])
        segment = table.column("segment").to_numpy()
        train = segment <= folds
        edges = [cuts(x[train, j], bins) if train.any() else np.zeros(0) for j in range(x.shape[1])]
        codes = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
        kind = np.uint8 if codes.max(initial=0) < 256 else np.uint16
        sizes = np.array([len(e) for e in edges], np.float64)
        return pa.table(
            {
                "symbol": table.column("symbol").slice(0, 1).cast(pa.string()),
                "n": pa.array([len(x)], pa.int32()),
                "codes": pa.array([codes.astype(kind).tobytes()], pa.binary()),
                "edges": pa.array([np.concatenate([sizes, *edges]).tobytes()], pa.binary()),
                "dates": pa.array([table.column("date").to_pylist()], pa.list_(pa.date32())),
                "y": pa.array([table.column("Target").to_numpy().astype(float)], pa.list_(pa.float64())),
                "segment": pa.array([segment.astype(np.int32)], pa.list_(pa.int32())),
                "split": pa.array([table.column("split").to_pylist()], pa.list_(pa.string())),
            }
        )

    return run


def _grow(width: int, folds: int, settings: dict[str, Settings]):
    def one(row: dict):
        codes = np.frombuffer(row["codes"], np.uint8 if len(row["codes"]) == row["n"] * width else np.uint16).reshape(-1, width)
        numbers = np.frombuffer(row["edges"])
        edges = np.split(numbers[width:], np.cumsum(numbers[:width].astype(int))[:-1])
        y, segment, fold = np.array(row["y"], float), np.array(row["segment"]), row["fold"]
        train = segment <= (folds if fold == FINAL else fold)
        if not train.any():
            return None
        model, yhat = fitted(codes, edges, y, train, settings[row["model"]], fold)
        shown = np.flatnonzero(np.ones(len(y), bool) if fold == FINAL else segment == fold + 1)
        rows = [{"date": row["dates"][i], "split": row["split"][i], "y": y[i], "yhat": yhat[i]} for i in shown]
        return {
            "symbol": row["symbol"],
            "model": row["model"],
            "fold": fold,
            "ensemble": bytes(model),
            "importance": model.importances(row["model"], width),
            "expected": expected(model),
            "n_train": int(train.sum()),
            "rows": rows,
        }

    kinds = pa.struct([("date", pa.date32()), ("split", pa.string()), ("y", pa.float64()), ("yhat", pa.float64())])
    schema = pa.schema(
        [
            ("symbol", pa.string()), ("model", pa.string()), ("fold", pa.int32()), ("ensemble", pa.binary()),
            ("importance", pa.list_(pa.float64())), ("expected", pa.float64()), ("n_train", pa.int64()), ("rows", pa.list_(kinds)),
        ]
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                made = one(batch.slice(i, 1).to_pylist()[0])
                if made is not None:
                    yield pa.RecordBatch.from_pylist([made], schema)

    return run


def expected(model: Ensemble) -> float:
    """Prediction of a row that goes down each split as the training rows do: base plus mean leaf by cover."""
    reach = np.zeros_like(model.cover)
    reach[:, 0] = 1.0
    total = model.base
    for node in range(model.feature.shape[1]):
        leaf = model.feature[:, node] < 0
        total += float((reach[leaf, node] * model.value[leaf, node]).sum())
        inner = np.flatnonzero(~leaf)
        if len(inner):
            for child in (2 * node + 1, 2 * node + 2):
                reach[inner, child] = reach[inner, node] * model.cover[inner, child] / model.cover[inner, node]
    return total


def fit_trees(
    segmented: DataFrame, names: list[str], models, folds: int = FOLDS, validate: bool = True, settings: dict[str, Settings] | None = None
) -> DataFrame:
    """symbol, model, fold, ensemble, importance, expected, n_train, rows: every model of every symbol.

    `segmented` has the columns of `evaluation.with_segments`.  Fold FINAL learns from all training rows and predicts all
    rows; fold t learns from the segments up to t and predicts segment t + 1.  A symbol without training rows has
    no model.  Rows with a null label or feature must have been dropped.
    """
    chosen = {m: (settings or SETTINGS)[m] for m in models}
    rows = segmented.select("symbol", "date", *names, "Target", "segment", "split")
    # Bins are those of the training part, the same for all folds; folds of a model share them.
    parts = None
    for bins in sorted({s.bins for s in chosen.values()}):
        own = [m for m, s in chosen.items() if s.bins == bins]
        wanted = [(m, f) for m in own for f in ([FINAL, *range(folds)] if validate else [FINAL])]
        pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("fold")) for m, f in wanted])
        binned = rows.groupBy("symbol").applyInArrow(_binned(names, folds, bins), _BINNED)
        part = binned.select("*", F.inline(pairs))
        parts = part if parts is None else parts.unionByName(part)
    # One row is one fit; they are dealt evenly.
    dealt = parts.repartition("symbol", "model", "fold")
    return dealt.mapInArrow(_grow(len(names), folds, chosen), _FITTED)


def tree_predictions(models: DataFrame) -> DataFrame:
    """symbol, date, model, fold, split, y, yhat from the rows of `fit_trees`."""
    rows = models.select("symbol", "model", "fold", F.inline("rows"))
    return rows.select("symbol", "date", "model", "fold", "split", "y", "yhat")


def tree_importances(models: DataFrame, names: list[str]) -> DataFrame:
    final = models.where(F.col("fold") == FINAL)
    named = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("importance"))
    return final.select("symbol", "model", F.inline(named))


def smaller(trees: int, **changes) -> dict[str, Settings]:
    """The registry's settings with another number of trees, for quick looks."""
    return {m: replace(s, trees=trees, **changes) for m, s in SETTINGS.items()}
