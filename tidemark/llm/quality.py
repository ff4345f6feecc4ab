"""Quality: support vectors on Naive Bayes features.

Indicators of n-grams, each counted once in a document: byte n-grams of the text, and n-grams of word shapes
(case, digits, marks at the end, length class, and whether a word repeats one of the words before it).  Each
indicator is scaled by the log ratio of its smoothed class counts; a linear hinge-loss model is fitted on the scaled
indicators by dual coordinate descent, and its weights are mixed with their mean size, as the method has it.
Margins of an inner fold that the model does not see give a logistic curve that turns margins into scores.

Fitting uses at most PER_CLASS labelled documents of each class and SAMPLE_BYTES of text (documented bounds); the curve is corrected to
the classes' shares among all labelled rows.  Without labels of both classes the score is the share of class 1
(one half without labels) for every row.  Null and empty texts have no indicators; their score follows from
the intercept.  Rows are scored one by one, so repeated rows and extra columns need no care.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import PER_CLASS, Sample, fitted, held_out, scored, shuffled, sigmoid
from tidemark.llm.words import Words, mix

BUCKETS = 1 << 18
BYTES = (1, 2, 3)
SHAPES = (1, 2, 3)
SMOOTHING = 1.0
COST = 0.1
BETA = 0.25
PASSES = 12
CUT = 0.3

_KIND = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 1 if "a" <= _c <= "z" or _i >= 128 else 2 if "A" <= _c <= "Z" else 4 if _c.isdigit() else 8


def _shapes(words: Words) -> np.ndarray:
    """A small number for each word that says how it looks."""
    first, last = _KIND[words.data[words.starts]], words.data[words.ends - 1]
    lengths = words.ends - words.starts
    middle = _KIND[words.data[(words.starts + words.ends) // 2]]
    mark = np.where(_KIND[last] == 8, last, 0)
    again = np.zeros(len(lengths), np.int64)
    for back in (2, 1):
        same = (words.hash[back:] == words.hash[:-back]) & (words.doc[back:] == words.doc[:-back])
        again[back:][same] = back
    size = np.digitize(lengths, (2, 4, 8, 14, 25, 60))
    code = (((first * 16 + middle.astype(np.int64)) * 256 + mark) * 8 + size) * 4 + again
    return mix(code.astype(np.uint64), 5)


def extract(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of byte n-grams and shape n-grams."""
    words = Words(data, offsets)
    docs, found = [], []
    where = np.repeat(np.arange(len(offsets) - 1), np.diff(words.offsets)).astype(np.int32)
    shapes = _shapes(words)
    for values, owner, sizes, salt in (
        (words.data.astype(np.uint32) + np.uint32(1), where, BYTES, 11),
        ((shapes >> np.uint64(32)).astype(np.uint32), words.doc.astype(np.int32), SHAPES, 23),
    ):
        for n in sizes:
            if len(values) < n:
                continue
            many = len(values) - n + 1
            h = np.full(many, salt + n, np.uint32)
            for j in range(n):
                h = (h ^ values[j : j + many]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            inside = owner[:many] == owner[n - 1 :]
            docs.append(owner[:many][inside])
            found.append(h[inside] % np.uint32(BUCKETS))
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    # Bytes run in document order already, so a stable sort only merges the few runs.
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return doc[order], np.concatenate(found)[order]


def hinge(features: list[np.ndarray], scale: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (of indicators, scale multiplied in) and intercept by dual coordinate descent."""
    weights, bias = np.zeros(len(scale)), 0.0
    dual = np.zeros(len(signs))
    rows = [scale[x] for x in features]
    norms = np.array([r @ r for r in rows]) + 1.0
    for epoch in range(PASSES):
        for i in shuffled(len(signs), epoch):
            x, r = features[i], rows[i]
            gradient = signs[i] * (weights[x] @ r + bias) - 1
            new = min(max(dual[i] - gradient / norms[i], 0.0), COST)
            if new != dual[i]:
                move = (new - dual[i]) * signs[i]
                weights[x] += move * r
                bias += move
                dual[i] = new
    # The mean size is added to every indicator that was seen; its scale gives it the sign.
    seen = scale != 0
    blend = BETA * weights + (1 - BETA) * (np.abs(weights[seen]).mean() if seen.any() else 0.0)
    return blend * scale, bias


def ratios(features: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed class shares of every indicator."""
    counts = [np.full(BUCKETS, SMOOTHING) for _ in range(2)]
    for x, y in zip(features, labels):
        counts[y][x] += 1
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def _trained(features, labels):
    scale = ratios(features, labels)
    scale[(np.bincount(np.concatenate(features), minlength=BUCKETS) if features else np.zeros(BUCKETS)) == 0] = 0
    return hinge(features, scale, np.where(labels == 1, 1.0, -1.0))


def fit(data: Sample) -> tuple[np.ndarray, float, float]:
    """Weights, slope and intercept of the score."""
    labels = data.labels
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    if not n0 or not n1:
        share = data.totals[1] / sum(data.totals) if sum(data.totals) else 0.5
        return np.zeros(BUCKETS), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    inner = shuffled(len(labels), 99)
    margins = np.zeros(len(labels))
    for fold in range(2):
        seen, unseen = inner[inner % 2 != fold], inner[inner % 2 == fold]
        if len(set(labels[seen])) < 2:
            continue
        w, b = _trained([data.features[i] for i in seen], labels[seen])
        margins[unseen] = [w[data.features[i]].sum() + b for i in unseen]
    slope, shift = _curve(margins, labels)
    weights, bias = _trained(data.features, labels)
    t0, t1 = data.totals
    return weights, slope, float(slope * bias + shift + np.log((t1 / n1) / (t0 / n0)))


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (over 0) and shift of a logistic curve through the margins, by Newton steps with smoothed targets."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    unit = margins.std() or 1.0
    x = np.stack([margins / unit, np.ones(len(margins))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(theta @ x)
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (p - goal) + 1e-3 * theta)
        theta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3) / unit), float(theta[1])


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs(doc_id, text)`; `labels(doc_id, quality)`."""
    weights, slope, intercept = fitted(docs, labels, "quality", extract, BUCKETS, fit, per_class)
    out = scored(docs, extract, weights, lambda x: sigmoid(slope * x + intercept)).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
