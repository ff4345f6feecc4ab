"""Spelling variants: words at one error from each other, by a bit-sliced position index.

Words are counted in the documents first (pre-aggregated in tasks), and those with MIN_LENGTH letters and MIN_COUNT
occurrences form the vocabulary.  Two words at one error differ at one place; around that place they agree.  So a word
of length t or t + 1 goes, for the shorter length t, to one group for each half of 0..t in which the place may lie: the group of all words
that agree outside the half.  A group of more than GROUP words is halved again, in place of itself, down to
single letters, where the alphabet bounds it; no group is cut and none is compared pair by pair.

Inside a group an index holds, for each place and letter, the set of words (one bit each) with that letter there.
The words that agree with a query so far (zero errors), and those one replaced, inserted or deleted letter away, are
bit sets; a letter of the query moves all of them at once, the sets after an insertion or deletion by looking one
place ahead or back.  The error is taken at the first difference, and a group counts it only inside its own half, so
every pair counts once.  Words stand in order of preference, so the first bit of the result is the word's form.

Null and empty texts have no words; with a null doc_id no letter is deleted.  Rows that repeat count each time.  Texts
are read whole, in pieces that end between words; words of any length are taken.  An empty table, or one without
words, gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import staged

MIN_LENGTH, MIN_COUNT = 7, 2
#: A word's form occurs so many times as often as the word, at least.
RATIO = 10
#: Occurrences by document with a checksum divisible by this lose a letter.
DELETE_EACH = 31
GROUP = 8192
#: Rows and letters that one task compares, about.
BUCKET_ROWS, BUCKET_LETTERS = 40_000, 1 << 20
PIECE = 1 << 20
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)
_END = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Letters a to z and U+00C0 to U+00FF, numbered from 1; 0 stands for none.
_LETTERS = 91
_NUMBER = np.zeros(256, np.uint8)
_NUMBER[97:123] = np.arange(1, 27)
_NUMBER[192:256] = np.arange(27, 91)
#: Places of the index that are in memory at a time, and bytes of it.
_PLACES, _INDEX_BYTES = 64, 1 << 26
_PAIRS = 1 << 18


# ---- vocabulary -----------------------------------------------------------------------------------------


def pieces(text: str):
    """The text in parts of about PIECE characters that end between words."""
    at = 0
    while at < len(text):
        cut = _END.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def _counted(batches):
    totals: Counter = Counter()
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            begin = None if doc is None else zlib.crc32(f"{doc}:".encode())
            for piece in pieces(text or ""):
                runs: Counter = Counter()
                for run, n in Counter(_RUN.findall(piece)).items():
                    runs[run.lower() if run.isascii() else run.translate(_LOWER)] += n
                for run, n in runs.items():
                    mark = 1 if begin is None else zlib.crc32(run.encode(), begin)
                    if mark % DELETE_EACH == 0:
                        place = mark % len(run)
                        run = run[:place] + run[place + 1 :]
                        if len(run) < MIN_LENGTH:
                            continue
                    totals[run] += n
        if len(totals) > 100_000:
            yield _batch(totals)
            totals = Counter()
    if totals:
        yield _batch(totals)


def _batch(totals: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"]
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of `docs(doc_id, text)` and their occurrences."""
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---- groups ---------------------------------------------------------------------------------------------


def _keyed(words: DataFrame) -> DataFrame:
    """Adds `key`: the word without the letters of its span [a, b) of 0..t, with t, a and b.

    A word that is longer than t has one letter more in its span.
    """
    around = F.concat_ws(
        "\u0001",
        *[F.col(c).cast("string") for c in ("t", "a", "b")],
        F.expr("left(word, a)"),
        F.expr("right(word, t - b)"),
    )
    return words.withColumn("key", around)


def _halves(words: DataFrame) -> DataFrame:
    """Every span replaced by its two halves; a span of one letter stays."""
    middle = F.expr("(a + b) div 2").cast("int")
    spans = F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))
    whole = F.array(F.struct("a", "b"))
    spans = F.when(F.col("b") - F.col("a") > 1, spans).otherwise(whole)
    return words.select("word", "n", "t", F.inline(spans))


def groups(words: DataFrame) -> DataFrame:
    """word, n, t, a, b, key: every word in each of its groups; none has more than GROUP words, but for single letters."""
    sizes = F.array(F.length("word") - 1, F.length("word"))
    each = words.select("word", "n", F.explode(sizes).alias("t"))
    waiting = _keyed(_halves(each.withColumns({"a": F.lit(0), "b": F.col("t")})))
    done = []
    while True:
        full = waiting.where("b - a > 1").groupBy("key").count().where(F.col("count") > GROUP).select("key")
        full = staged(full, "full-groups")
        if full.isEmpty():
            return _union([*done, waiting])
        done.append(waiting.join(full, "key", "left_anti").select(*waiting.columns))
        waiting = staged(_keyed(_halves(waiting.join(full, "key", "left_semi"))), "halved-groups")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- index and search -----------------------------------------------------------------------------------


def letters(words: list[str], width: int) -> np.ndarray:
    """Letter numbers, a row for each word."""
    out = np.zeros((len(words), width), np.uint8)
    joined = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.array([len(w) for w in words])
    out[np.arange(width) < lengths[:, None]] = _NUMBER[joined]
    return out


def _sliced(rows: np.ndarray, lane: np.ndarray, bit: np.ndarray, lanes: int, first: int) -> np.ndarray:
    """Bit sets by (lane, place, letter) of _PLACES places from `first` on, with one more on either side."""
    out = np.zeros((lanes, _PLACES + 2, _LETTERS), np.uint64)
    places = np.arange(max(first - 1, 0), min(first + _PLACES + 1, rows.shape[1]))
    for p in places:
        np.bitwise_or.at(out, (lane, p - first + 1, rows[:, p]), bit)
    # Letter 0 is no letter: a query that has ended meets no word there.
    out[:, :, 0] = 0
    return out


def near_sets(rows: np.ndarray, longer: np.ndarray, lane: np.ndarray, place: np.ndarray, query: np.ndarray, at: np.ndarray, span, t: int) -> np.ndarray:
    """Bit sets of the words of a lane at one error from a query, for pairs (query, lane `at`).

    `rows`: letters of the words, `longer`: whether a word has t + 1 letters, `lane` and `place`: its bit;
    `span`: first and last place of the error for each query's group.
    """
    lanes = int(lane.max()) + 1
    bit = np.uint64(1) << place.astype(np.uint64)
    short, long = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
    np.bitwise_or.at(short, lane[~longer], bit[~longer])
    np.bitwise_or.at(long, lane[longer], bit[longer])
    zero = (short | long)[at]
    own = lane[query] == at
    zero[own] &= ~bit[query[own]]
    replaced, ahead, behind = (np.zeros(len(query), np.uint64) for _ in range(3))
    first, last = span[0][query], span[1][query]
    ends = longer[query]
    for i in range(t + 1):
        if i % _PLACES == 0:
            table = _sliced(rows, lane, bit, lanes, i)
        letter, p = rows[query, i], i % _PLACES + 1
        same = table[at, p, letter]
        apart = np.where((first <= i) & (i < last), zero & ~same, np.uint64(0))
        live = ends if i == t else np.ones(len(query), bool)
        ahead = np.where(live, (ahead | apart) & table[at, p + 1, letter], ahead)
        behind = np.where(live, (behind & table[at, p - 1, letter]) | apart, behind)
        replaced = np.where(live, (replaced & same) | apart, replaced)
        zero = np.where(live, zero & same, zero)
    tail = np.where(last > t, zero, np.uint64(0))
    return np.where(ends, behind & short[at], (replaced & short[at]) | ((ahead | tail) & long[at]))


def _compared(words: list[str], n: np.ndarray, group: np.ndarray, span, t: int):
    """(place of word, near words, place of the first of them) of words ordered by group and preference."""
    rows = letters(words, t + 1)
    longer = rows[:, t] > 0
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    within = np.arange(len(group)) - np.repeat(starts, sizes)
    lanes = -(-sizes // 64)
    first_lane = np.cumsum(lanes) - lanes
    lane, place = np.repeat(first_lane, sizes) + within // 64, within % 64
    lane_start = np.repeat(starts, lanes) + 64 * (np.arange(lanes.sum()) - np.repeat(first_lane, lanes))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    for a, b in _parts(lanes, max(1, _INDEX_BYTES // ((_PLACES + 2) * _LETTERS * 8))):
        low, high, base = starts[a], starts[b - 1] + sizes[b - 1], first_lane[a]
        own = slice(low, high)
        # A query looks into every lane of its group.
        count = np.repeat(lanes[a:b], sizes[a:b])
        ends = np.cumsum(count)
        cuts = np.searchsorted(ends, np.arange(_PAIRS, ends[-1] + _PAIRS, _PAIRS), "left")
        for i, j in zip(np.r_[0, cuts[:-1]], np.minimum(cuts, len(count))):
            each = count[i:j]
            query = np.repeat(np.arange(i, j), each)
            at = np.repeat(np.repeat(first_lane[a:b], sizes[a:b])[i:j] - base - (np.cumsum(each) - each), each)
            at = at + np.arange(each.sum())
            bits = near_sets(rows[own], longer[own], lane[own] - base, place[own], query, at, (span[0][own], span[1][own]), t)
            found = np.flatnonzero(bits)
            np.add.at(near, low + query[found], np.bitwise_count(bits[found]).astype(np.int64))
            lowest = np.bitwise_count((bits[found] & (~bits[found] + np.uint64(1))) - np.uint64(1))
            np.minimum.at(best, low + query[found], lane_start[at[found] + base] + lowest)
    hit = np.flatnonzero(near)
    return hit, near[hit], best[hit]


def _parts(lanes: np.ndarray, most: int):
    """Ranges of groups with at most `most` lanes, about; a larger group is a range of its own."""
    a, total = 0, 0
    for i, k in enumerate(lanes):
        if i > a and total + k > most:
            yield a, i
            a, total = i, 0
        total += k
    if len(lanes):
        yield a, len(lanes)


_FOUND = "word string, n_near long, less long, form string"
_TYPES = [("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("form", pa.string())]


def _searched(table: pa.Table) -> pa.Table:
    """n_near and the best near word (its negative n, so that the smallest is best) of the words of some groups."""
    table = table.sort_by([("t", "ascending"), ("key", "ascending"), ("n", "descending"), ("word", "ascending")]).combine_chunks()
    t = table.column("t").to_numpy()
    key = table.column("key").dictionary_encode().combine_chunks().indices.to_numpy()
    alone = np.bincount(key)[key] == 1
    table, t, key = table.filter(pa.array(~alone)), t[~alone], key[~alone]
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    n = table.column("n").to_numpy()
    edges = np.r_[np.flatnonzero(np.diff(t, prepend=-1)), len(t)]
    out = [pa.schema(_TYPES).empty_table()]
    for i, j in zip(edges[:-1], edges[1:]):
        words = table.column("word").slice(i, j - i).to_pylist()
        size = int(t[i])
        # Of the last span the error may also lie behind the shorter word.
        span = a[i:j], np.where(b[i:j] == size, size + 1, b[i:j])
        hit, near, best = _compared(words, n[i:j], key[i:j], span, size)
        out.append(
            pa.table(
                {
                    "word": pa.array([words[x] for x in hit], pa.string()),
                    "n_near": pa.array(near),
                    "less": pa.array(-n[i:j][best].astype(np.int64)),
                    "form": pa.array([words[x] for x in best], pa.string()),
                }
            )
        )
    return pa.concat_tables(out)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of the words of `words(word, n)` that have near words; form is the best of these."""
    grouped = staged(groups(words), "groups")
    size = grouped.agg(F.count("*"), F.sum(F.length("word"))).first()
    buckets = max(1, -(-size[0] // BUCKET_ROWS), -(-(size[1] or 0) // BUCKET_LETTERS))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    found = grouped.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_searched, _FOUND)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root: the last of the forms that begin at a word of `links(word, form)`, each round twice as far."""
    ahead = staged(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(ahead.join(further, "root", "left"), "roots")
        ahead = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.where("next is not null").isEmpty():
            return ahead


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of `docs(doc_id, text)`."""
    words = staged(vocabulary(docs), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    good = F.col("form_n") >= F.lit(RATIO) * F.col("n")
    near = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("form")).alias("form"),
        F.when(good, F.col("form_n")).alias("form_n"),
    )
    near = staged(near, "near-words")
    roots = _roots(near.where("form is not null").select("word", "form"))
    out = near.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
