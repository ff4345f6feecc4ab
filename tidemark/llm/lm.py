"""Language-model scores from an Elias-Fano trie of n-grams with quantised smoothed probabilities.

The model has three levels.  A word's base probability is its count plus one over all training tokens, distinct tokens
and one.  Bigrams and trigrams are interpolated with the level below by absolute discounting, so the probabilities of
all words after a context add up to one; a context that training has not seen passes to the level below.  Stored
logarithms are rounded to STEP.

A trie covers the contexts whose nearest word falls to one shard.  Its levels are monotone sequences (nearest words,
their successors, words before them, successors of both) in Elias-Fano form with monotone pointers; the third level
names a word by its place among the successors of the nearest word, a context-relative number.  Sequences and
probabilities lie in one run of bytes and are read in place.

Distinct words of chunks of documents meet by word and get their counts and
numbers, small ones for frequent words, which return to the chunks; trigrams with the documents that have them meet by context, where a task builds the trie of its
shard from the training documents and looks up all of them, equal ones once; sums by document return.  Equal trigrams of a
document are one entry.  A nearest word with HOT occurrences or more is spread over shards by count / HOT + 1 classes of the word
before it (entries of one pair of words stay together).  Its bigrams are counted over all classes: they meet by nearest
word and successor, and each shard gets the counts of those that its entries have, and the word's total and number of
successors.  So HOT and the numbers of shards have no influence on scores.  The model grows with
the corpus: nothing is sampled, cut or pruned.

Tokens are maximal runs without white space, A-Z lower-cased, and an end for each document.  Null and empty texts have
the end alone.  Rows whose crc32 of doc_id as text leaves HELD_REST by HELD_FOLDS are held out; a null doc_id is not.  Rows that
repeat count each time and get a row each.  Documents of any length are taken whole, in chunks of CHUNK tokens that
know the two tokens before them.  Without training documents every probability is one.  An empty table gives no rows.
Extra columns are ignored.  `docs` is read twice and has to give the same rows in the same partitions, as a written
table does; if it does not, the job fails.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.succinct import EliasFano, Packed, distinct
from tidemark.llm.words import Words, buffers, mix, slices
from tidemark.sources.sinks import staged

HELD_FOLDS, HELD_REST = 7, 2
DISCOUNT = 0.75
#: Rounding of stored logarithms (base 10), and bits of each.
STEP, BITS = 0.01, 11
#: Tokens of a chunk (less than 2^21, see `_entries`), bytes read at a time, tokens of a shard, text bytes of a word shard.
CHUNK, SLICE, SHARD, WORD_BYTES = 1 << 20, 6 << 20, 400_000, 16 << 20
#: Occurrences from which a nearest word is spread, and occurrences of spread words to a shard of their bigrams.
HOT, PAIRS = 1_000_000, 1 << 21
_END = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id="doc_id"):
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_FOLDS
    return F.coalesce(rest == HELD_REST, F.lit(False))


def quantised(p: np.ndarray) -> np.ndarray:
    """Numbers of steps below zero of the logarithms."""
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, (1 << BITS) - 1).astype(np.int64)


def probability(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-STEP * code)


def bundle(*arrays) -> bytes:
    """Non-negative integers of several arrays, each in as many bytes as its largest needs, compressed."""
    out = []
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        kind = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
        a = np.ascontiguousarray(a).astype(f"u{kind}")
        out += [struct.pack("<BQ", kind, len(a)), *((a >> a.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(kind))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unbundle(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<BQ", data, at)
        raw = np.frombuffer(data, np.uint8, kind * n, at + 9).reshape(kind, n)
        a = raw[0].astype(np.uint64 if kind == 8 else np.int64)
        for i in range(1, kind):
            a |= raw[i].astype(a.dtype) << a.dtype.type(8 * i)
        out.append(a)
        at += 9 + kind * n
    return out


_NONE = np.zeros(0, np.int64)


# ---- trie -----------------------------------------------------------------------------------------------


class Trie:
    """Smoothed trigrams, bigrams and backing-off weights of some contexts.

    `words`: numbers of its words in order; `nearest`: words of level 1 (the word before); `after`: successors of each;
    `before`: the word before that one; `third`: successors of both, by their place in `after`.
    """

    SEQUENCES = ("nearest", "starts", "after", "before", "third")
    CODES = ("nearest_weight", "after_code", "before_weight", "third_code")

    def __init__(self, words: np.ndarray, most: int, sequences: list[EliasFano], codes: list[Packed]):
        self.words, self.most = words, most
        for name, value in (*zip(self.SEQUENCES, sequences), *zip(self.CODES, codes)):
            setattr(self, name, value)

    @classmethod
    def built(
        cls, b: np.ndarray, a: np.ndarray, c: np.ndarray, n: np.ndarray, words: np.ndarray, base: np.ndarray, spread: tuple[np.ndarray, ...] = (_NONE,) * 6
    ) -> Trie:
        """From occurrences n of c after b after a; -1 as a stands for no word.  b, a, c are places in `words`; `base`: codes of the words.

        `spread`: nearest words of which other tries have entries too, their totals and numbers of successors over all tries; nearest
        word, successor and count over all tries of the bigrams of such words that are asked for here, which include those of the entries.
        """
        far, far_total, far_kinds, far_b, far_c, far_n = spread
        used = np.zeros(len(words), bool)
        for x in (b, c, a[a >= 0], far, far_c):
            used[x] = True
        place = np.cumsum(used) - 1
        words, base = words[used], base[used]
        b, c, a = place[b], place[c], np.where(a >= 0, place[np.maximum(a, 0)], -1)
        size = max(len(words), 1)

        used = np.zeros(len(words), bool)
        used[b] = used[place[far]] = True
        nearest, ranks = np.flatnonzero(used), np.cumsum(used) - 1
        rank, far = ranks[b], ranks[place[far]]
        after, at = distinct(np.r_[rank * size + c, ranks[place[far_b]] * size + place[far_c]])
        at, far_at = at[: len(b)], at[len(b) :]
        count = np.bincount(at, n, len(after))
        count[far_at] = far_n
        owner = after // size
        total, kinds = np.bincount(owner, count, len(nearest)), np.bincount(owner, minlength=len(nearest))
        every = kinds.copy()
        total[far], every[far] = far_total, far_kinds
        weight = quantised(DISCOUNT * every / np.maximum(total, 1))
        p = (count - DISCOUNT) / total[owner] + probability(weight)[owner] * probability(base[after % size])
        after_code = quantised(p)
        starts = np.cumsum(kinds) - kinds

        full = a >= 0
        before, context = distinct(rank[full] * size + a[full])
        most = int(kinds.max()) if len(kinds) else 1
        third, at3 = distinct(context * most + at[full] - starts[rank[full]])
        count = np.bincount(at3, n[full], len(third))
        owner = third // most
        total, kinds = np.bincount(owner, count, len(before)), np.bincount(owner, minlength=len(before))
        before_weight = quantised(DISCOUNT * kinds / np.maximum(total, 1))
        lower = probability(after_code[starts[before // size][owner] + third % most])
        p = (count - DISCOUNT) / total[owner] + probability(before_weight)[owner] * lower
        sequences = [
            EliasFano.of(nearest, size),
            EliasFano.of(starts, len(after) + 1),
            EliasFano.of(after, size * len(nearest)),
            EliasFano.of(before, size * len(nearest)),
            EliasFano.of(third, most * len(before)),
        ]
        return cls(words, most, sequences, [Packed.of(x, BITS) for x in (weight, after_code, before_weight, quantised(p))])

    def __bytes__(self) -> bytes:
        arrays = [self.words, np.array([self.most], np.uint64)]
        for name in self.SEQUENCES:
            arrays += getattr(self, name).arrays()
        arrays += [getattr(self, name).words for name in self.CODES]
        sizes = np.array([len(arrays), *map(len, arrays)], np.uint64)
        return b"".join(np.ascontiguousarray(x, np.uint64).tobytes() for x in (sizes, *arrays))

    @classmethod
    def mapped(cls, data) -> Trie:
        """The trie in some bytes, which are not copied."""
        whole = np.frombuffer(data, np.uint64)
        sizes = whole[1 : 1 + int(whole[0])].astype(np.int64)
        ends = 1 + len(sizes) + np.cumsum(sizes)
        arrays = iter([whole[e - s : e] for e, s in zip(ends, sizes)])
        words, most = next(arrays), int(next(arrays)[0])
        sequences = [EliasFano.read(arrays) for _ in cls.SEQUENCES]
        return cls(words, most, sequences, [Packed(next(arrays), BITS) for _ in cls.CODES])

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Place of each number among the words, -1 where it is missing."""
        if not len(self.words):
            return np.full(len(numbers), -1, np.int64)
        numbers = numbers.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.words, numbers), len(self.words) - 1)
        return np.where(self.words[at] == numbers, at, -1)

    def ranks(self) -> np.ndarray:
        """Place of each word among the nearest words, -1 where it is none."""
        return self.nearest.find(np.arange(len(self.words)))

    def codes(self, rank: np.ndarray, a: np.ndarray, c: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Code of each word c after the nearest word `rank` after a (-1: no or an unknown word); `base` is its code without a context.

        Neighbours that share a context look it up once.
        """
        size = max(len(self.words), 1)
        seen = np.flatnonzero(rank >= 0)
        out = base.astype(np.int64).copy()
        rank, a, c = rank[seen], a[seen], c[seen]
        two = np.where(c >= 0, self.after.find(rank * size + c), -1)
        code = np.where(two >= 0, self.after_code[np.maximum(two, 0)], out[seen] + self.nearest_weight[rank])
        first, each = _runs(rank * (size + 1) + a)
        context = np.repeat(np.where(a[first] >= 0, self.before.find(rank[first] * size + a[first]), -1), each)
        known = np.flatnonzero(context >= 0)
        code[known] += self.before_weight[context[known]]
        both = known[two[known] >= 0]
        first, each = _runs(rank[both])
        place = two[both] - np.repeat(self.starts.values(rank[both[first]]), each)
        three = self.third.find(context[both] * self.most + place)
        hit = both[three >= 0]
        code[hit] = self.third_code[three[three >= 0]]
        out[seen] = code
        return out


# ---- chunks ---------------------------------------------------------------------------------------------


def _chunks(batches):
    """Tokens of up to CHUNK of some documents, in the order of the table, with two tokens before them.

    Yields the key, tokens, how many of them lead, document of each other token, first place of the first document,
    and the range of rows of the batch and of the partition.  The key depends on the tokens: another read of the
    table finds its chunk only with the same tokens in it.
    """
    partition, row, number = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in slices(offsets, SLICE):
            words = Words(data, offsets[i : j + 1], lower=True)
            lengths = words.counts() + 1
            tokens = np.full(lengths.sum(), _END)
            tokens[np.arange(len(words.hash)) + words.doc] = words.hash
            doc = np.repeat(np.arange(j - i), lengths)
            first = np.cumsum(lengths) - lengths
            for a in range(0, len(tokens), CHUNK):
                b = min(a + CHUNK, len(tokens))
                lead = min(2, a)
                mark = np.array([(partition << 32) + number, 0], np.uint64)
                mark = mix(mark, 500) ^ mix(tokens[a - lead : b].sum(keepdims=True), 501)
                d = doc[a]
                rows = slice(i + d, i + doc[b - 1] + 1)
                own = (partition << 40) + row + i + d
                yield int(mark[:1].view(np.int64)[0]), tokens[a - lead : b], lead, doc[a:b] - d, a - first[d], batch, rows, own
                number += 1
        row += batch.num_rows


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _distinct_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the place of each.

    Their high bits are sorted with places in the low ones; hashes that differ in the low bits only, which are rare, need the slower way.
    """
    bits = np.uint64(len(hashes).bit_length())
    both = np.sort(hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64))
    at = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = hashes[at]
    if (ordered[1:] < ordered[:-1]).any():
        return np.unique(hashes, return_inverse=True)
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)]
    out = np.empty(len(hashes), np.int64)
    out[at] = np.cumsum(new) - 1
    return ordered[new], out


_WORDS = "shard long, chunk long, words binary"


def _asked(shards: int):
    """Distinct words of a chunk and their occurrences in training documents, a row for each word shard."""

    def run(batches):
        for key, tokens, lead, doc, _, batch, rows, _ in _chunks(batches):
            train = ~batch.column("held").slice(rows.start, rows.stop - rows.start).to_numpy(zero_copy_only=False)
            words, at = _distinct_hashes(tokens)
            counts = np.bincount(at[lead:], train[doc], len(words)).astype(np.int64)
            shard = _word_shard(words, shards)
            edges = np.searchsorted(shard, np.arange(shards + 1).astype(np.uint64))
            made = [(s, bundle(words[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.int64()), pa.array([key] * len(made), pa.int64()), pa.array([m[1] for m in made], pa.binary())],
                ["shard", "chunk", "words"],
            )

    return run


_COUNTS = "shard long, chunk long, counts binary, tokens long, kinds long, hot long"
_COUNT_FIELDS = [("shard", pa.int64()), ("chunk", pa.int64()), ("counts", pa.binary()), *((x, pa.int64()) for x in ("tokens", "kinds", "hot"))]


def _counted(shards: int):
    def run(table: pa.Table) -> pa.Table:
        """Occurrences and numbers of the words of each chunk, in its order; the first row also has those of the shard, its
        distinct words and the occurrences of words to spread.  Numbers go by occurrences and tell shards apart."""
        parts = [unbundle(x.as_py()) for x in table.column("words")]
        words, at = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        numbers = np.empty(len(words), np.int64)
        numbers[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * shards + table.column("shard")[0].as_py()
        ends = np.cumsum([len(p[0]) for p in parts])
        places = [at[e - len(p[0]) : e] for p, e in zip(parts, ends)]
        found = [bundle(counts[x], numbers[x]) for x in places]
        rest = [0] * (len(parts) - 1)
        columns = [table.column("shard"), table.column("chunk"), pa.array(found, pa.binary())]
        columns += [pa.array([int(x), *rest], pa.int64()) for x in (counts.sum(), (counts > 0).sum(), counts[counts >= HOT].sum())]
        return pa.Table.from_arrays(columns, schema=pa.schema(_COUNT_FIELDS))

    return run


_CHUNK = "chunk long, tokens binary, docs binary"


def _written(batches):
    """Chunks as rows: places of the tokens among the chunk's distinct words, and what is known of the documents."""
    for key, tokens, lead, doc, begin, batch, rows, own in _chunks(batches):
        part = batch.slice(rows.start, rows.stop - rows.start)
        words, at = _distinct_hashes(tokens)
        ids = part.column("doc_id")
        docs = bundle(
            np.array([own, lead, begin]),
            ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64),
            np.asarray(ids.is_null()).astype(np.int64),
            part.column("held").to_numpy(zero_copy_only=False).astype(np.int64),
            np.bincount(doc, minlength=part.num_rows),
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.array([bundle(at, np.array([len(words)]))], pa.binary()), pa.array([docs], pa.binary())],
            ["chunk", "tokens", "docs"],
        )


# ---- contexts -------------------------------------------------------------------------------------------


#: Bits of a word of a chunk in a key.
_LOW = (1 << 21) - 1


def _entries(t, doc, place, shard, docs: int):
    """Sorted distinct (shard, b, a, c, document) of the tokens that have a word before them, with multiplicities.

    A chunk has less than 2^21 different words, so b, a (plus one; 0: none) and c fit one number.
    """
    lead = len(t) - len(doc)
    full = np.r_[np.full(2 - lead, 0), t] if lead < 2 else t
    b, a = full[1 : 1 + len(doc)], np.where(place >= 2, full[: len(doc)] + 1, 0)
    own = np.flatnonzero(place >= 1)
    b, a, c = b[own], a[own], t[lead:][own]
    pair, at = distinct((b << 21) | a)
    to = shard(pair >> 21, pair & _LOW)
    order = np.argsort(to.astype(np.uint16) if to.max(initial=0) < 1 << 16 else to, kind="stable")
    rank = np.empty(len(pair), np.int64)
    rank[order] = np.arange(len(pair))
    pair, to = pair[order], to[order]
    # Tokens come by document, so their places put equal trigrams in the order of documents.
    key = np.sort((rank[at] << 42) | (c << 21) | np.arange(len(c)))
    doc, at = doc[own][key & _LOW], key >> 42
    to, key = to[at], (pair[at] << 21) | ((key >> 21) & _LOW)
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)])
    return to[new], key[new], doc[new], np.diff(np.r_[new, len(key)])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values."""
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return first, np.diff(np.r_[first, len(values)])


_CHANGED = "the documents differ between two reads; write them to a table first"
_ASKED = "shard long, chunk long, data binary"


def _split(numbers: np.ndarray, classes: np.ndarray, salt: int) -> np.ndarray:
    return mix(numbers, salt) % classes


def _shard(numbers: np.ndarray, split: np.ndarray, shards: int, salt: int) -> np.ndarray:
    """Shard of a part of a nearest word."""
    return (mix(numbers + split * np.uint64(0x9E3779B97F4A7C15), salt) % np.uint64(shards)).astype(np.int64)


def _pairs(to, key, n, words, classes, pair_shards: int):
    """Messages on the bigrams of spread words: their counts, and the shards whose entries have them."""
    numbers = words.astype(np.uint64)
    first, sizes = _runs(to)
    targets, to = to[first], np.repeat(np.arange(len(first)), sizes)
    k, at = np.unique((key >> 42 << 42) | ((key & _LOW) << 21) | to, return_inverse=True)
    n = np.bincount(at, n, len(k)).astype(np.int64)
    b, c = k >> 42, (k >> 21) & _LOW
    own = _shard(numbers[b], _split(numbers[c], classes[b], 504), pair_shards, 505)
    order = np.argsort(own, kind="stable")
    k, n, own = k[order], n[order], own[order]
    for at, size in zip(*_runs(own)):
        part = k[at : at + size]
        pair, to_each = _runs(part >> 21)
        one, pair_each = _runs(part[pair] >> 42)
        b, c = part[pair][one] >> 42, (part[pair] >> 21) & _LOW
        used = np.unique(np.concatenate([b, c]))
        data = bundle(
            np.diff(words[used], prepend=0), np.searchsorted(used, b), classes[b], pair_each, np.searchsorted(used, c),
            np.add.reduceat(n[at : at + size], pair), to_each, targets[part & _LOW],
        )
        yield int(own[at]), data


def _used(values: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Sorted distinct values; `scratch`, which covers all values and may hold anything, gets the place of each."""
    places = np.arange(len(values))
    scratch[values] = places
    used = np.sort(values[scratch[values] == places])
    scratch[used] = np.arange(len(used))
    return used


def _sent(shards: int, pair_shards: int, tokens: int, kinds: int):
    """Messages of a chunk: a header, entries for shards, and bigrams of spread words, whose shards follow the others."""
    total = tokens + kinds + 1

    def run(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        if not chunk.num_rows or not counts.num_rows:
            raise ValueError(_CHANGED)
        row, counts = chunk.to_pylist()[0], counts.sort_by("shard")
        t, size = unbundle(row["tokens"])
        (own, lead, begin), ids, null, held, lengths = unbundle(row["docs"])
        answers = [unbundle(x.as_py()) for x in counts.column("counts")]
        c, words = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in answers]]) for i in (0, 1))
        if len(c) != size[0]:
            raise ValueError(_CHANGED)
        own, lead, begin = int(own), int(lead), int(begin)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(doc)) - starts[doc]
        place[doc == 0] += begin
        base = quantised((c + 1) / total)
        mine, head = t[lead:], np.flatnonzero(place == 0)
        logs = np.bincount(doc, np.log10(c + 1.0)[mine], len(lengths)) - lengths * np.log10(total)
        known = np.bincount(doc, (c > 0)[mine], len(lengths)).astype(np.int64)
        alone = np.bincount(doc[head], base[mine[head]], len(lengths)).astype(np.int64)
        header = bundle(np.array([own]), ids, null, held, lengths, known, logs.view(np.uint64), alone)
        out = [(-1 - (row["chunk"] & 0x7FFFFFFF), header)]

        classes, numbers = (c // HOT + 1).astype(np.uint64), words.astype(np.uint64)
        # From here on a chunk's words stand in the order of their numbers.
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        t, words, base, classes, numbers = rank[t], words[order], base[order], classes[order], numbers[order]

        def shard(b, a):
            split = np.where(a > 0, _split(numbers[np.maximum(a - 1, 0)], classes[b], 502), np.uint64(0))
            return _shard(numbers[b], split, shards, 503)

        to, key, doc, times = _entries(t, doc, place, shard, len(lengths))
        hot = np.flatnonzero(classes[key >> 42] > 1)
        counted = np.where(held.astype(bool)[doc[hot]], 0, times[hot])
        out += [(shards + at, data) for at, data in _pairs(to[hot], key[hot], counted, words, classes, pair_shards)]
        bits = np.packbits(held.astype(bool)).astype(np.int64)
        three, docs_each = _runs(key)
        k = key[three]
        two, three_each = _runs(k >> 21)
        one, two_each = _runs((to[three[two]] << 21) | (k[two] >> 42))
        b, a, w = k[two[one]] >> 42, ((k[two] >> 21) & _LOW) - 1, k & _LOW
        first, sizes = _runs(to)
        ends = [np.searchsorted(x, np.r_[first, len(to)]) for x in (three[two[one]], three[two], three)]
        scratch = np.empty(len(words) + 1, np.int64)
        for i, (at, n) in enumerate(zip(first, sizes)):
            x, y, z = (slice(e[i], e[i + 1]) for e in ends)
            used = _used(np.concatenate([b[x], a[y][a[y] >= 0], w[z]]), scratch)
            data = bundle(
                np.diff(words[used], prepend=0), base[used], scratch[b[x]], two_each[x], np.where(a[y] >= 0, scratch[a[y]] + 1, 0), three_each[y],
                scratch[w[z]], docs_each[z], doc[at : at + n], times[at : at + n], bits, np.array([len(held)]),
            )
            out.append((int(to[at]), data))
        return pa.table(
            {
                "shard": pa.array([x[0] for x in out], pa.int64()),
                "chunk": pa.array([row["chunk"]] * len(out), pa.int64()),
                "data": pa.array([x[1] for x in out], pa.binary()),
            }
        )

    return run


_ANSWERS = "shard long, data binary"


def _answered(shards: int):
    """Bigrams of spread words by the shard that asked: words, totals, successors, bigrams each; successors and counts."""

    def run(table: pa.Table) -> pa.Table:
        made = []
        if table.column("shard")[0].as_py() >= shards:
            parts = [unbundle(x.as_py()) for x in table.column("data")]
            words, at = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
            ends = np.cumsum([len(p[0]) for p in parts])
            own = [at[e - len(p[0]) : e] for p, e in zip(parts, ends)]
            size, classes = len(words), np.zeros(len(words), np.uint64)
            for p, w in zip(parts, own):
                classes[w[p[1]]] = p[2].astype(np.uint64)
            pair = np.concatenate([np.repeat(w[p[1]], p[3]) * size + w[p[4]] for p, w in zip(parts, own)])
            pairs, at = np.unique(pair, return_inverse=True)
            count = np.bincount(at, np.concatenate([p[5] for p in parts]), len(pairs)).astype(np.int64)
            seen = np.flatnonzero(count)
            total = np.bincount(pairs[seen] // size, count[seen], size).astype(np.int64)
            kinds = np.bincount(pairs[seen] // size, minlength=size)
            # All shards of a word get its figures, also those without any of these bigrams.
            nearest = np.flatnonzero(kinds)
            b = np.repeat(nearest, classes[nearest].astype(np.int64))
            split = np.arange(len(b)) - np.repeat(*_runs(b))
            heads = np.unique(_shard(words[b].astype(np.uint64), split.astype(np.uint64), shards, 503) * size + b)
            asked = np.repeat(at, np.concatenate([p[6] for p in parts])), np.concatenate([p[7] for p in parts])
            asked = np.unique((asked[1] * len(pairs) + asked[0])[count[asked[0]] > 0])
            to, what = asked // len(pairs), asked % len(pairs)
            each = np.bincount(np.searchsorted(heads, to * size + pairs[what] // size), minlength=len(heads))
            first, lengths = _runs(heads // size)
            rows = np.r_[0, np.cumsum(each)]
            for i, n in zip(first, lengths):
                b, own = heads[i : i + n] % size, what[rows[i] : rows[i + n]]
                data = bundle(np.diff(words[b], prepend=0), total[b], kinds[b], each[i : i + n], words[pairs[own] % size], count[own])
                made.append((int(heads[i] // size), data))
        return pa.table({"shard": pa.array([m[0] for m in made], pa.int64()), "data": pa.array([m[1] for m in made], pa.binary())})

    return run


def _spread(parts: list[list[np.ndarray]], words: np.ndarray) -> tuple[np.ndarray, ...]:
    """The answers that a shard gets as `Trie.built` takes them."""
    if not parts:
        return (_NONE,) * 6
    number, total, kinds, each, c, n = (np.concatenate([np.cumsum(p[0]) if i == 0 else p[i] for p in parts]) for i in range(6))
    b = np.repeat(number, each)
    far, at = np.unique(number, return_inverse=True)
    total, kinds = (np.bincount(at, x, len(far)).astype(np.int64) for x in (total, kinds))
    # Not every class of a word has entries.
    have = np.isin(far, words)
    return np.searchsorted(words, far[have]), total[have], kinds[have], np.searchsorted(words, b), np.searchsorted(words, c), n


def _received(parts: list[list[np.ndarray]]):
    """Words of all messages of a shard and their base; trigrams of each message with places in the words, and their entries;
    document, times and train of the entries, and entries and documents of each message."""
    words, base, to = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if parts:
        words, at = distinct(np.concatenate([np.cumsum(p[0]) for p in parts]))
        base = np.zeros(len(words), np.int64)
        base[at] = np.concatenate([p[1] for p in parts])
        ends = np.cumsum([len(p[0]) for p in parts])
        to = [at[e - len(p[0]) : e] for p, e in zip(parts, ends)]
    columns = [[] for _ in range(7)]
    for p, own in zip(parts, to):
        b, two, a, three, c, docs, doc, times, bits, n = p[2:]
        held = np.unpackbits(bits.astype(np.uint8), count=int(n[0])).astype(bool)
        b = np.repeat(np.repeat(own[b], two), three)
        a = np.repeat(np.where(a > 0, own[np.maximum(a - 1, 0)], -1), three)
        for column, x in zip(columns, (b, a, own[c], docs, doc, times, ~held[doc])):
            column.append(x)
    columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in columns]
    return words, base, columns[:4], columns[4:], [(len(p[8]), int(p[11][0])) for p in parts]


_SUMS = "chunk long, header boolean, data binary"


def _scored(shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _summed(table if table.num_rows and table.column("shard")[0].as_py() < shards else table.slice(0, 0), answers)

    return run


def _sums(doc: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents, of which there are `size`, and sums of their weights; those with a sum of 0 may be left out."""
    if size > 8 * len(doc):
        doc, at = distinct(doc)
        return doc, np.bincount(at, weights, len(doc)).astype(np.int64)
    sums = np.bincount(doc, weights, size)
    doc = np.flatnonzero(sums)
    return doc, sums[doc].astype(np.int64)


def _summed(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums of codes by document for each message of a shard; headers pass."""
    if not table.num_rows:
        made = []
    elif table.column("shard")[0].as_py() < 0:
        made = [(x.as_py(), True, d.as_py()) for x, d in zip(table.column("chunk"), table.column("data"))]
    else:
        words, base, (b, a, c, docs), (doc, times, train), sizes = _received([unbundle(x.as_py()) for x in table.column("data")])
        found = [unbundle(x.as_py()) for x in answers.column("data")] if answers.num_rows else []
        # Equal trigrams of all messages are one from here on, in the order of the trie.
        _, at = distinct(b * (len(words) + 1) + a + 1)
        grams, at = distinct(at * len(words) + c)
        some = np.empty(len(grams), np.int64)
        some[at] = np.arange(len(at))
        b, a, c, at = b[some], a[some], c[some], np.repeat(at, docs)
        n = np.bincount(at, times * train, len(grams)).astype(np.int64)
        seen = np.flatnonzero(n)
        trie = Trie.mapped(bytes(Trie.built(b[seen], a[seen], c[seen], n[seen], words, base, _spread(found, words))))
        ids, ranks = np.r_[trie.ids(words), -1], np.r_[trie.ranks(), -1]
        codes = np.empty(len(b), np.int64)
        for i in range(0, len(b), 1 << 17):
            own = slice(i, i + (1 << 17))
            codes[own] = trie.codes(ranks[ids[b[own]]], ids[a[own]], ids[c[own]], base[c[own]])
        weights, made, i = codes[at] * times, [], 0
        for x, (entries, size) in zip(table.column("chunk"), sizes):
            j = i + entries
            made.append((x.as_py(), False, bundle(*_sums(doc[i:j], weights[i:j], size))))
            i = j
    kinds = (pa.int64(), pa.bool_(), pa.binary())
    return pa.table({k: pa.array([m[i] for m in made], kinds[i]) for i, k in enumerate(("chunk", "header", "data"))})


_DOCS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, codes long"


def _gathered(table: pa.Table) -> pa.Table:
    """Figures of the documents of a chunk; a document may lie in several."""
    header, sums = None, []
    for is_header, data in zip(table.column("header").to_pylist(), table.column("data")):
        if is_header:
            header = unbundle(data.as_py())
        else:
            sums.append(unbundle(data.as_py()))
    own, ids, null, held, lengths, known, logs, codes = header
    for doc, more in sums:
        codes[doc] += more
    n = len(lengths)
    columns = [
        pa.array(int(own[0]) + np.arange(n)),
        pa.array(ids.astype(np.uint64).view(np.int64), mask=null.astype(bool)),
        pa.array(held.astype(bool)),
        pa.array(lengths),
        pa.array(known),
        pa.array(logs.astype(np.uint64).view(np.float64)),
        pa.array(codes),
    ]
    return pa.Table.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "codes"])


# ---- jobs -----------------------------------------------------------------------------------------------


def _messages(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int] | None:
    """Trigrams of all chunks by shard, bigrams of spread words, the number of shards, and the training tokens; None for an empty table."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held"))
    size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if not size[0]:
        return None
    word_shards = -(-(size[1] or 1) // WORD_BYTES)
    counts = docs.mapInArrow(_asked(word_shards), _WORDS).groupBy("shard").applyInArrow(_counted(word_shards), _COUNTS)
    counts = staged(counts, "word-counts")
    tokens, kinds, hot = counts.agg(F.sum("tokens"), F.sum("kinds"), F.sum("hot")).first()
    chunks = docs.mapInArrow(_written, _CHUNK).groupBy("chunk")
    # About six bytes of text to a token.
    shards = -(-(size[1] or 1) // (6 * SHARD))
    sent = _sent(shards, max(1, -(-hot // PAIRS)), tokens, kinds)
    messages = chunks.cogroup(counts.groupBy("chunk")).applyInArrow(sent, _ASKED)
    if hot:
        # Grouped as for the scores, so that both read one shuffle.
        answers = messages.groupBy("shard").applyInArrow(_answered(shards), _ANSWERS)
    else:
        answers = docs.sparkSession.createDataFrame([], _ANSWERS)
    return messages, answers, shards, tokens


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs(doc_id, text)`."""
    made = _messages(docs)
    if made is None:
        empty = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return docs.sparkSession.createDataFrame([], empty)
    messages, answers, shards, tokens = made
    sums = messages.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_scored(shards), _SUMS)
    parts = sums.groupBy("chunk").applyInArrow(_gathered, _DOCS)
    total = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "codes")]
    rows = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *total)
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", (F.col("codes") * -STEP).alias("score")
    )
