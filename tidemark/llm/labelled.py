"""Bounded samples of labelled documents for fitting, and scoring of whole tables by fitted weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import buffers, give_back, lean, slices
from tidemark.sources.sinks import staged

#: Labelled documents of each class that a fit uses at most, the first by hash of doc_id.
PER_CLASS = 4000
#: Bytes of text that a fit uses at most.
SAMPLE_BYTES = 64 << 20
FOLDS = 5


def held_out(doc_id="doc_id"):
    """True for ids whose crc32 (of the id as text) leaves no rest by FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Sample:
    """Feature numbers of the sampled documents, their labels, and labelled rows of both classes in all."""

    features: list[np.ndarray]
    labels: np.ndarray
    totals: tuple[int, int]


def distinct(found: tuple[np.ndarray, np.ndarray], n: int, size: int):
    """Sorted distinct feature numbers of each of n documents, from (document, number) in document order."""
    doc, number = found
    bounds = np.searchsorted(doc, np.arange(n + 1))
    seen = np.zeros(size, bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = number[a:b]
        if len(own) * 20 < size:
            yield np.unique(own)
        else:
            seen[own] = True
            yield np.flatnonzero(seen)
            seen[own] = False


def chosen(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, tuple[int, int]]:
    """doc_id, label, text of labelled documents outside the held-out fold, and labelled rows of both classes in all.

    At most `per_class` documents of each class, the first by hash of doc_id, and of these as many as have `most_bytes` of
    text together.  Labels other than 0 and 1 are left out; of several labels of one doc_id the largest counts, of
    several texts the one with the smallest hash.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    first = known.where("label = 0").orderBy(*order).limit(per_class)
    first = first.unionByName(known.where("label = 1").orderBy(*order).limit(per_class))
    # At most 2 * per_class ids, so the broadcast is bounded.
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(first), "doc_id").withColumn("_mark", F.xxhash64("text"))
    rows = staged(rows.select("doc_id", "label", "text", "_mark"), "labelled")
    sizes = rows.groupBy("doc_id").agg(F.min(F.struct("_mark", F.octet_length("text").alias("n"))).alias("s"))
    # One small row for each sampled document.
    total = F.sum("s.n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.withColumn("_total", total).where(F.col("_total") <= most_bytes).select("doc_id", F.col("s._mark").alias("_mark"))
    picked = rows.join(kept, ["doc_id", "_mark"]).dropDuplicates(["doc_id"]).select("doc_id", "label", "text")
    return picked, (counts.get(0, 0), counts.get(1, 0))


def fitted(docs: DataFrame, labels: DataFrame, label: str, extract, size: int, fit, per_class: int = PER_CLASS) -> tuple:
    """What `fit(Sample)` makes of the chosen documents: weights, then numbers.

    The fit runs in one task, which the bounds of the sample keep small; only weights that are not zero come back.
    """
    rows, totals = chosen(docs, labels, label, per_class)

    def run(table: pa.Table) -> pa.Table:
        ids, marks = (table.column(c).to_numpy() for c in ("doc_id", "label"))
        features = []
        for chunk in table.column("text").chunks:
            data, offsets = buffers(chunk)
            for i, j in slices(offsets):
                features += [x.astype(np.uint32) for x in distinct(extract(data, offsets[i : j + 1]), j - i, size)]
        # The texts go before the fit begins.
        del table, chunk, data
        order = np.argsort(ids, kind="stable")
        weights, *rest = fit(Sample([features[i] for i in order], marks[order].astype(np.int8), totals))
        places = np.flatnonzero(weights)
        del features
        give_back()
        made = [places.astype(np.uint32).tobytes(), weights[places].tobytes(), np.array(rest, float).tobytes()]
        return pa.table({k: pa.array([v], pa.binary()) for k, v in zip(("places", "weights", "rest"), made)})

    found = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "places binary, weights binary, rest binary").collect()
    if not found:
        return fit(Sample([], np.zeros(0, np.int8), totals))
    weights = np.zeros(size)
    weights[np.frombuffer(found[0]["places"], np.uint32)] = np.frombuffer(found[0]["weights"])
    return weights, *np.frombuffer(found[0]["rest"]).tolist()


def shuffled(n: int, epoch: int) -> np.ndarray:
    return np.random.default_rng(1000 + epoch).permutation(n)


def scored(docs: DataFrame, extract, weights: np.ndarray, to_score) -> DataFrame:
    """doc_id, score of every row; weights of distinct features add up, `to_score` maps the sum to (0, 1).

    Only the non-zero weights travel to the tasks; the number of buckets bounds them.
    """
    size = len(weights)
    places = np.flatnonzero(weights).astype(np.uint32)
    values = weights[places]

    def run(batches):
        dense = np.zeros(size)
        dense[places] = values
        live = dense != 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                doc, number = extract(data, offsets[i : j + 1])
                used = live[number]
                sums = [dense[x].sum() for x in distinct((doc[used], number[used]), j - i, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(to_score(np.array(sums)), pa.float64())],
                    ["doc_id", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
