"""Substring dedup by seed and extend.

Seeds: of every window of LENGTH words the smallest hash of its SEED-word grams is an anchor (winnowing), so equal
windows always share their anchor.  Anchors that two documents share are joined; only around them matches are extended
to both sides, to the windows that chose the anchor.  A window (96 bits of two hashes of its words) is a repeat
in every document but those with its smallest doc_id; runs of repeated windows make the maximal repeats,
whose words are removed.

Documents are dealt into chunks of about CHUNK rows and CHUNK_BYTES of text by hash, once; a chunk sends each anchor and each window
it asks about at most once, so a passage that very many documents share costs one entry per chunk, not one per
document, and no group is gathered.  Chunks and answering buckets grow in number with the rows, not in size.

Null and empty texts have no words.  A null doc_id counts as larger than any number.  Rows with equal doc_id are
one document: they do not remove each other's words.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import SPACES, Words, buffers, grams, mix, pack, slices, unpack

LENGTH = 13
SEED = 5
CHUNK, CHUNK_BYTES = 2000, 16 << 20
_LAST = np.iinfo(np.int64).max


def _ids(table: pa.Table) -> np.ndarray:
    column = table.column("doc_id").combine_chunks()
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(table: pa.Table):
    """First row and Words of the chunk's documents, slice by slice."""
    data, offsets = buffers(table.column("text").combine_chunks())
    for i, j in slices(offsets):
        yield i, Words(data, offsets[i : j + 1])


def _windows(words: Words, length: int) -> np.ndarray:
    """Numbers of the words at which a window of one document starts."""
    n = len(words.hash) - length + 1
    return np.flatnonzero(words.doc[:n] == words.doc[length - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _anchors(words: Words, length: int) -> np.ndarray:
    """The anchor of the window that would start at each word."""
    least = grams(words.hash, SEED, 17)
    span, left = 1, length - SEED + 1
    # Minimum over `left` grams by doubling.
    while span * 2 <= left:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (left - span)], least[left - span :]) if left > span else least


def _marks(words: Words, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the windows that start at `at`."""
    low = grams(words.hash, length, 71)[at]
    high = grams(mix(words.hash, 72), length, 73)[at] >> np.uint64(32)
    return low, high.astype(np.uint32)


def _dealt(bucket: np.ndarray, buckets: int, *values: np.ndarray):
    """Values of each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    values = [v[order] for v in values]
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), *(v[bounds[b] : bounds[b + 1]] for v in values)


def _ask_anchors(buckets: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        """Distinct anchors of the chunk, and whether several of its documents have them."""
        chunk, ids = table.column("chunk")[0].as_py(), _ids(table)
        values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, words in _parts(table):
            at = _windows(words, length)
            if not len(at):
                continue
            value, doc = _anchors(words, length)[at], ids[i + words.doc[at]]
            new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
            values.append(value[new])
            owners.append(doc[new])
        values, owners = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
        several = np.zeros(len(first), bool)
        if len(first):
            several = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)
        values = values[first]
        rows = list(_dealt((values % np.uint64(buckets)).astype(np.int64), buckets, values, several))
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int64()),
                "chunk": pa.array([chunk] * len(rows), pa.int64()),
                "anchors": pa.array([pack(r[1]) for r in rows], pa.binary()),
                "several": pa.array([np.packbits(r[2]).tobytes() for r in rows], pa.binary()),
            }
        )

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For each chunk, those of its anchors that documents share."""
    chunks = table.column("chunk").to_pylist()
    lists = [unpack(x, np.uint64) for x in table.column("anchors").to_pylist()]
    several = [
        np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool)
        for x, v in zip(table.column("several").to_pylist(), lists)
    ]
    sizes = np.array([len(v) for v in lists])
    values, own = np.concatenate(lists), np.concatenate(several)
    order = np.argsort(values, kind="stable")
    run = np.cumsum(np.r_[True, values[order][1:] != values[order][:-1]]) - 1
    shared = np.zeros(len(values), bool)
    shared[order] = ((np.bincount(run) > 1) | (np.bincount(run, own[order]) > 0))[run]
    bounds = np.cumsum(np.r_[0, sizes])
    rows = [(c, v[shared[a:b]]) for c, v, a, b in zip(chunks, lists, bounds, bounds[1:])]
    rows = [(c, v) for c, v in rows if len(v)]
    return pa.table(
        {"chunk": pa.array([c for c, _ in rows], pa.int64()), "anchors": pa.array([pack(v) for _, v in rows], pa.binary())}
    )


def _ask_windows(buckets: int, length: int):
    empty = {"bucket": pa.int64(), "chunk": pa.int64(), "low": pa.binary(), "high": pa.binary(), "docs": pa.binary()}

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Distinct windows around shared anchors, each with the chunk's smallest doc_id that has it."""
        if not table.num_rows or not answers.num_rows:
            return pa.table({k: pa.array([], v) for k, v in empty.items()})
        chunk, ids = table.column("chunk")[0].as_py(), _ids(table)
        shared = np.sort(np.concatenate([unpack(x, np.uint64) for x in answers.column("anchors").to_pylist()]))
        found = []
        for i, words in _parts(table):
            at = _windows(words, length)
            if not len(at):
                continue
            anchors = _anchors(words, length)[at]
            at = at[shared[np.minimum(np.searchsorted(shared, anchors), len(shared) - 1)] == anchors]
            found.append((*_marks(words, length, at), ids[i + words.doc[at]]))
        low, high, docs = (np.concatenate(x) for x in zip(*found))
        first, _ = _runs(low, high, order := np.lexsort((high, low)))
        low, high, docs = low[order][first], high[order][first], np.minimum.reduceat(docs[order], first) if len(first) else docs
        rows = list(_dealt((low % np.uint64(buckets)).astype(np.int64), buckets, low, high, docs))
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int64()),
                "chunk": pa.array([chunk] * len(rows), pa.int64()),
                "low": pa.array([pack(r[1]) for r in rows], pa.binary()),
                "high": pa.array([r[2].tobytes() for r in rows], pa.binary()),
                "docs": pa.array([pack(r[3]) for r in rows], pa.binary()),
            }
        )

    return run


def _runs(low: np.ndarray, high: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal windows begin in this order, and the number of the run of each place."""
    low, high = low[order], high[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(low)]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each chunk, those of its windows that a smaller doc_id of another chunk has."""
    chunks = table.column("chunk").to_pylist()
    lows = [unpack(x, np.uint64) for x in table.column("low").to_pylist()]
    highs = [np.frombuffer(x, np.uint32) for x in table.column("high").to_pylist()]
    docs = np.concatenate([unpack(x) for x in table.column("docs").to_pylist()])
    low, high = np.concatenate(lows), np.concatenate(highs)
    first, run = _runs(low, high, order := np.lexsort((high, low)))
    later = np.zeros(len(low), bool)
    later[order] = docs[order] > np.minimum.reduceat(docs[order], first)[run]
    bounds = np.cumsum([0, *(len(x) for x in lows)])
    rows = [(c, x[later[a:b]], y[later[a:b]]) for c, x, y, a, b in zip(chunks, lows, highs, bounds, bounds[1:])]
    rows = [r for r in rows if len(r[1])]
    return pa.table(
        {
            "chunk": pa.array([r[0] for r in rows], pa.int64()),
            "low": pa.array([pack(r[1]) for r in rows], pa.binary()),
            "high": pa.array([r[2].tobytes() for r in rows], pa.binary()),
        }
    )


def _repeated(ids: np.ndarray, parts: list, answers: pa.Table, length: int) -> list[np.ndarray]:
    """For each part, the words at which a repeated window starts."""
    starts = [_windows(words, length) for _, words in parts]
    made = [_marks(words, length, at) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.uint32)) for (_, words), at in zip(parts, starts)]
    low, high = (np.concatenate(x) for x in zip(*made))
    docs = np.concatenate([ids[i + words.doc[at]] for (i, words), at in zip(parts, starts)])
    if not len(low):
        return starts
    # Equal windows meet by the first hash; the second tells apart what agrees by chance.
    order = np.argsort(low, kind="stable")
    first, run = _runs(low, high, order)
    gone = np.zeros(len(low), bool)
    gone[order] = docs[order] > np.minimum.reduceat(docs[order], first)[run]
    if answers.num_rows:
        keys = np.concatenate([unpack(x, np.uint64) for x in answers.column("low").to_pylist()])
        seconds = np.concatenate([np.frombuffer(x, np.uint32) for x in answers.column("high").to_pylist()])
        by = np.lexsort((seconds, keys))
        keys, seconds = keys[by], seconds[by]
        place = np.searchsorted(keys, low)
        while True:
            inside = np.minimum(place, len(keys) - 1)
            same = (place < len(keys)) & (keys[inside] == low)
            gone |= same & (seconds[inside] == high)
            open_ = same & (seconds[inside] < high)
            if not open_.any():
                break
            place = place + open_
    bounds = np.cumsum([0, *map(len, starts)])
    return [at[gone[a:b]] for at, a, b in zip(starts, bounds, bounds[1:])]


def _kept(words: Words, gone: np.ndarray) -> list[str]:
    """Texts of the words that stay, joined by one space."""
    size = len(words.data)
    change = np.zeros(size + 2, np.int8)
    starts, ends = words.starts[~gone], words.ends[~gone]
    change[starts] += 1
    change[ends] -= 1
    inside = np.cumsum(change[:size], dtype=np.int8).astype(bool)
    data = np.where(SPACES[words.data], np.uint8(32), words.data)
    # One white space byte after each word stays as the separator; the last of a document is stripped.
    gap = ends[(ends < size)]
    gap = gap[SPACES[words.data[gap]]]
    inside[gap] = True
    places = np.concatenate([[0], np.cumsum(inside)])[words.offsets]
    data = data[inside].tobytes()
    return [data[a:b].rstrip(b" ").decode() for a, b in zip(places[:-1], places[1:])]


def _cut(length: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """What is left of each document, and the maximal repeats that went."""
        columns = {k: [] for k in ("n_words", "n_removed", "kept", "spans")}
        ids = _ids(table) if table.num_rows else np.zeros(0, np.int64)
        parts = list(_parts(table)) if table.num_rows else []
        gone_at = _repeated(ids, parts, answers, length) if parts else []
        for (_, words), at in zip(parts, gone_at):
            n = len(words.offsets) - 1
            change = np.zeros(len(words.starts) + length + 1, np.int64)
            change[at] += 1
            change[at + length] -= 1
            gone = np.cumsum(change[: len(words.starts)]) > 0
            counts = words.counts()
            bounds = np.cumsum(np.r_[0, counts])
            removed = np.concatenate([[0], np.cumsum(gone)])[bounds]
            columns["n_words"] += counts.tolist()
            columns["n_removed"] += np.diff(removed).tolist()
            columns["kept"] += _kept(words, gone)
            edge = np.r_[True, words.doc[1:] != words.doc[:-1]][: len(gone)]
            begin = np.flatnonzero(gone & (edge | np.r_[True, ~gone[:-1]][: len(gone)]))
            end = np.flatnonzero(gone & (np.r_[edge[1:], True] | np.r_[~gone[1:], True])) if len(gone) else begin
            spans = [[] for _ in range(n)]
            for a, b in zip(begin, end):
                d = words.doc[a]
                spans[d].append({"first": int(a - bounds[d]), "last": int(b - bounds[d])})
            columns["spans"] += spans
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(columns["n_words"], pa.int64()),
                "n_removed": pa.array(columns["n_removed"], pa.int64()),
                "kept": pa.array(columns["kept"], pa.string()),
                "spans": pa.array(columns["spans"], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            }
        )

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, chunk_rows: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), spans (first and last word of each maximal repeat)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, math.ceil(rows / chunk_rows), math.ceil((size or 0) / CHUNK_BYTES))
    own = F.xxhash64(F.col("doc_id").cast("string"), "text")
    # All three passes group by chunk, so Spark shuffles the texts once and reads them again.
    dealt = docs.withColumn("chunk", F.pmod(own, F.lit(n)).cast("long"))
    chunks = dealt.groupBy("chunk")
    asked = chunks.applyInArrow(_ask_anchors(n, length), "bucket long, chunk long, anchors binary, several binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer_anchors, "chunk long, anchors binary")
    asked = chunks.cogroup(answers.groupBy("chunk")).applyInArrow(
        _ask_windows(n, length), "bucket long, chunk long, low binary, high binary, docs binary"
    )
    answers = asked.groupBy("bucket").applyInArrow(_answer_windows, "chunk long, low binary, high binary")
    return chunks.cogroup(answers.groupBy("chunk")).applyInArrow(
        _cut(length), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,last:long>>"
    )
