"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are maximal runs without white space and ASCII punctuation, lower-cased.  Features are single words,
their stems (first bytes, so that endings do not matter), pairs of neighbours, and pairs with one or two words
between them, hashed to BUCKETS; each counts once in a document.  Per-coordinate rates learn rare words fast; the L1 term keeps all but telling features at zero, so
the weights that travel to the tasks are few.

Fitting uses at most PER_CLASS labelled documents of each class and SAMPLE_BYTES of text (documented bounds) and corrects the
intercept to the classes' shares among all labelled rows.  Without labels of both classes the score is the
share of class 1 (0 without labels) for every row.

Null and empty texts have no features; their score follows from the intercept.  Rows are scored one by one,
so repeated rows and extra columns need no care.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import PER_CLASS, Sample, fitted, held_out, scored, shuffled, sigmoid
from tidemark.llm.words import MARKS, Words, lean, mix

BUCKETS = 1 << 20
GAPS = (1, 2, 3)
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2.0, 0.1
EPOCHS = 4
CUT = 0.5


def extract(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of words, stems, neighbouring pairs and skip pairs."""
    words = Words(data, offsets, separators=MARKS, lower=True)
    docs, found = [words.doc], [words.hash]
    for length in STEMS:
        docs.append(words.doc)
        found.append(words.stems(length))
    for gap in GAPS:
        inside = words.doc[:-gap] == words.doc[gap:]
        pair = mix(words.hash[:-gap] * np.uint64(3) + words.hash[gap:], 50 + gap)
        docs.append(words.doc[:-gap][inside])
        found.append(pair[inside])
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return doc[order], (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int64)


def fit(data: Sample) -> tuple[np.ndarray, float]:
    """Weights and intercept."""
    total, accumulated = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = np.zeros(2)
    weights = np.zeros(BUCKETS)
    n0, n1 = (data.labels == 0).sum(), (data.labels == 1).sum()
    if not n0 or not n1:
        share = sum(data.totals) and data.totals[1] / sum(data.totals)
        return weights, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    b = 0.0
    for epoch in range(EPOCHS):
        for i in shuffled(len(data.labels), epoch):
            x = data.features[i]
            z, n = total[x], accumulated[x]
            w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
            gradient = sigmoid(w.sum() + b) - data.labels[i]
            step = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA
            total[x] = z + gradient - step * w
            accumulated[x] = n + gradient * gradient
            step = (np.sqrt(bias[1] + gradient * gradient) - np.sqrt(bias[1])) / ALPHA
            bias += gradient - step * b, gradient * gradient
            b = -bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)
    live = np.abs(total) > L1
    z, n = total[live], accumulated[live]
    weights[live] = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    t0, t1 = data.totals
    return weights, float(b + np.log((t1 / n1) / (t0 / n0)))


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    return scored(docs, extract, weights, lambda x: sigmoid(x + intercept))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs(doc_id, text)`; `labels(doc_id, toxic)`."""
    model = fitted(docs, labels, "toxic", extract, BUCKETS, fit, per_class)
    out = score(docs, *model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """`docs` without rows scored toxic, all columns kept."""
    weights, intercept = fitted(docs, labels, "toxic", extract, BUCKETS, fit, per_class)
    return filtered(docs, weights, intercept)


def filtered(docs: DataFrame, weights: np.ndarray, intercept: float, cut: float = CUT) -> DataFrame:
    """Rows below the cut; a task scores its rows in place, nothing is shuffled."""
    import pyarrow as pa

    from tidemark.llm.labelled import distinct
    from tidemark.llm.words import buffers, slices

    places = np.flatnonzero(weights).astype(np.uint32)
    values = weights[places]

    def run(batches):
        dense = np.zeros(BUCKETS)
        dense[places] = values
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                doc, number = extract(data, offsets[i : j + 1])
                used = dense[number] != 0
                sums = [dense[x].sum() for x in distinct((doc[used], number[used]), j - i, BUCKETS)]
                keep = sigmoid(np.array(sums) + intercept) < cut
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
