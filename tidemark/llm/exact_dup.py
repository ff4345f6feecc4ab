"""Exact duplicates by counting quotient filters and byte verification.

Every partition builds counting quotient filters (`quotient`) of its 64-bit text fingerprints, one for each block of their
upper bits.  Filters of one block from all partitions merge by their sorted remainders without loss, so that a text
that very many rows share costs two slots for each partition.  Fingerprints counted more than once send their rows to
verification: each row's bytes are compared with one text of that fingerprint, and rows that differ (two texts
with one fingerprint) are grouped by the text itself.

A null text counts as empty.  Of equal texts the row with the largest doc_id stays (a null doc_id is smaller
than any number; a group of nulls has a null keep_id and its rows count as kept).  Rows that repeat both doc_id
and text are marked alike; `exact_dedup` keeps one of them.  Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quotient import QuotientFilter, merged
from tidemark.sources.sinks import staged

#: Fingerprints that a merging task is to hold, about.
BLOCK_ROWS = 50_000


def _filters(bits: int):
    rest = np.uint64((1 << (64 - bits)) - 1)

    def run(batches):
        """Filters of the whole partition."""
        seen = [np.zeros(0, np.uint64)]
        for batch in batches:
            seen.append(batch.column("_fp").to_numpy(zero_copy_only=False).view(np.uint64).copy())
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        block = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        for a, b in zip(edges, np.r_[edges[1:], len(values)]):
            made = bytes(QuotientFilter.of(values[a:b] & rest, counts[a:b], 64 - bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[a])], pa.int64()), pa.array([made], pa.binary())], ["block", "filter"]
            )

    return run


def _merge(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """One block of all partitions: the fingerprints that were counted more than once."""
        whole = merged([QuotientFilter.read(x.as_py()) for x in table.column("filter")])
        values, counts = whole.items()
        base = (table.column("block")[0].as_py() << (64 - bits)) if bits else 0
        more = counts > 1
        return pa.table({"_fp": (values[more] | np.uint64(base)).view(np.int64), "_many": counts[more]})

    return run


def repeated_fingerprints(docs: DataFrame, rows: int) -> DataFrame:
    """(_fp, _many) of the fingerprints that more than one row of `docs(_fp)` has."""
    bits = max(0, (rows // BLOCK_ROWS).bit_length())
    filters = docs.select("_fp").mapInArrow(_filters(bits), "block long, filter binary")
    return filters.groupBy("block").applyInArrow(_merge(bits), "_fp long, _many long")


def _classed(docs: DataFrame, columns: list[str], normal) -> tuple[DataFrame, DataFrame]:
    """Rows whose text is alone, and rows of repeated texts with _class, _keep and _size.

    `_text` holds the normalised text; it is kept for repeated texts only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    text = normal(text) if normal else text
    docs = docs.select(*columns, F.col("doc_id").alias("_id"), text.alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    many = staged(repeated_fingerprints(docs, docs.count()), "fingerprints")
    marked = docs.withColumn("_sha", F.sha2("_text", 256)).join(many, "_fp", "left")
    marked = staged(marked.withColumn("_text", F.when(F.col("_many").isNotNull(), F.col("_text"))), "marked")

    single = marked.where("_many is null").drop("_text", "_fp", "_many")
    rows = marked.where("_many is not null")
    # One text of each fingerprint; the partial maximum leaves one per task before the shuffle.
    # Written tables on both sides of the joins let Spark split a very large group.
    sample = staged(rows.groupBy("_fp").agg(F.max("_text").alias("_sample")), "samples")
    rows = rows.join(sample, "_fp").withColumn("_odd", F.when(F.col("_text") != F.col("_sample"), F.col("_text")))
    rows = staged(rows.drop("_text", "_sample", "_many"), "verified")
    rows = rows.withColumns({"_other": F.col("_odd").isNotNull(), "_odd": F.coalesce("_odd", F.lit(""))})
    stats = rows.groupBy("_fp", "_odd", "_other").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
    return single, rows.join(staged(stats, "classes"), ["_fp", "_odd", "_other"])


def exact_groups(docs: DataFrame, normal=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of `docs(doc_id, text)`.

    `normal` maps the text column to the form that is compared; None compares texts as they are.
    """
    single, many = _classed(docs, [], normal)
    kept = F.coalesce(F.col("_id") == F.col("_keep"), F.col("_keep").isNull())
    alone = single.select(
        F.col("_id").alias("doc_id"),
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    return alone.unionByName(
        many.select(
            F.col("_id").alias("doc_id"),
            F.col("_keep").alias("keep_id"),
            F.col("_size").alias("group_size"),
            kept.alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def exact_dedup(docs: DataFrame, normal=None) -> DataFrame:
    """`docs` with one row of each distinct text, all columns kept."""
    columns = docs.columns
    single, many = _classed(docs.select(F.struct(*columns).alias("_row"), "doc_id", "text"), ["_row"], normal)
    # Rows alike in doc_id and text may differ in other columns; their hash decides.
    one = F.min_by("_row", F.xxhash64("_row")).alias("_row")
    many = many.where("_id <=> _keep").groupBy("_fp", "_odd", "_other").agg(one)
    return single.select("_row.*").unionByName(many.select("_row.*"))
