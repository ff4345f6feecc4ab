import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.tables import WORD, corpus, docs, prose
from tidemark.llm import lm
from tidemark.llm.succinct import EliasFano, Packed, distinct

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
END = 0


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), END]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """The model spelled out, with exact probabilities."""

    def __init__(self, rows):
        train = [tokens(t) for i, t in rows if not held(i)]
        self.n = [Counter(), Counter(), Counter()]
        for w in train:
            for k in range(3):
                self.n[k].update(zip(*(w[j:] for j in range(k + 1))))
        self.total, self.kinds = sum(self.n[0].values()), len(self.n[0])
        self.after = [Counter(), Counter()], [Counter(), Counter()]
        for k in (1, 2):
            for gram, n in self.n[k].items():
                self.after[0][k - 1][gram[:-1]] += n
                self.after[1][k - 1][gram[:-1]] += 1

    def p(self, *gram):
        if len(gram) == 1:
            return (self.n[0][gram] + 1) / (self.total + self.kinds + 1)
        k = len(gram) - 1
        context, lower = gram[:-1], self.p(*gram[1:])
        total, kinds = self.after[0][k - 1][context], self.after[1][k - 1][context]
        if not total:
            return lower
        return max(self.n[k][gram] - lm.DISCOUNT, 0) / total + lm.DISCOUNT * kinds / total * lower

    def log(self, w):
        return sum(math.log10(self.p(*w[max(0, i - 2) : i + 1])) for i in range(len(w)))


def check(got, rows):
    plain = Plain(rows)
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(tokens(t))
    for r in got:
        own = [w for w in want[r.doc_id] if len(w) == r.n_tokens]
        assert own and r.held_out == held(r.doc_id) and r.train_tokens == plain.total
        w = min(own, key=lambda w: abs(sum(math.log10(plain.p(c)) for c in w) - r.base_score))
        assert r.n_known == sum(plain.n[0][(c,)] > 0 for c in w)
        assert r.base_score == pytest.approx(sum(math.log10(plain.p(c)) for c in w), abs=1e-8)
        # Every token is off by half a step for its own entry and half for each weight it backs off by, at most.
        assert abs(r.score - plain.log(w)) <= 2.5 * lm.STEP * len(w)
    return plain


def test_scores_against_a_plain_model(spark):
    rows = corpus() + [(200 + i, "the same words come again and again " * (i + 1) + prose(i, 15)) for i in range(40)]
    rows += [(400, "THE Same words"), (401, "ÀÉ é " * 3)]
    check(lm.scores(docs(spark, rows)).collect(), rows)


def test_small_chunks_and_shards_change_nothing(spark, monkeypatch):
    """Documents that lie in several chunks know the tokens before them."""
    rows = corpus()
    one = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in lm.scores(docs(spark, rows)).collect()}
    for name, value in (("CHUNK", 97), ("SLICE", 2000), ("SHARD", 500), ("WORD_BYTES", 9000)):
        monkeypatch.setattr(lm, name, value)
    other = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in lm.scores(docs(spark, rows)).collect()}
    assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k], abs=1e-9) for k in one)


def test_frequent_words_are_spread(spark, monkeypatch):
    rows = [(i, "the " + " the ".join(prose(i, 30).split())) for i in range(80)]
    whole = lm.scores(docs(spark, rows)).collect()
    monkeypatch.setattr(lm, "HOT", 200)
    monkeypatch.setattr(lm, "SHARD", 300)
    split = lm.scores(docs(spark, rows)).collect()
    a, b = ({r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 7)) for r in x} for x in (whole, split))
    assert a == b
    # Classes of the word before are contexts of their own, so scores move a little.
    gap = [abs(x.score - y.score) / x.n_tokens for x, y in zip(sorted(whole), sorted(split))]
    assert 0 < max(gap) < 0.5


def test_the_size_from_which_words_are_spread_changes_nothing(spark, monkeypatch):
    """Bigrams of spread words are counted over all shards, those that only held-out documents have included."""
    rows = [(i, " ".join(f"{w} {('the', 'of', 'the the')[k % 3]}" for k, w in enumerate(prose(i, 30).split()))) for i in range(80)]
    rows += [(1000 + i, "of the the of the " + prose(i, 6)) for i in range(30)] + [(None, "the of " * 40), (5, "the"), (5, "")]
    whole = sorted(lm.scores(docs(spark, rows)).collect(), key=str)
    check(whole, rows)
    for hot, shard, pairs in ((200, 300, 1 << 21), (200, 300, 100), (3, 50, 70), (1, 10**6, 500)):
        for name, value in (("HOT", hot), ("SHARD", shard), ("PAIRS", pairs)):
            monkeypatch.setattr(lm, name, value)
        split = sorted(lm.scores(docs(spark, rows)).collect(), key=str)
        assert [(*r[:5], round(r.base_score, 7), r.score) for r in split] == [(*r[:5], round(r.base_score, 7), r.score) for r in whole]


def test_probabilities_add_up():
    r = np.random.default_rng(1)
    text = r.zipf(1.5, 4000) % 200
    c, b, a = text[2:], text[1:-1], text[:-2]
    base_p = (np.bincount(text, minlength=200) + 1) / (len(text) + 201)
    base = lm.quantised(base_p)
    trie = lm.Trie.mapped(bytes(lm.Trie.built(b, a, c, np.ones(len(c), np.int64), np.arange(200), base)))
    ids, ranks = trie.ids(np.arange(200)), np.r_[trie.ranks(), -1]
    for x, y in [(int(a[i]), int(b[i])) for i in range(0, 3000, 60)] + [(-1, int(b[5])), (199, 199)]:
        codes = trie.codes(np.full(200, ranks[ids[y]]), np.full(200, ids[x] if x >= 0 else -1), ids, base)
        # The unknown word has the rest of the base distribution.
        weight = lm.probability(trie.codes(np.array([ranks[ids[y]]]), np.array([ids[x] if x >= 0 else -1]), np.array([-1]), lm.quantised(np.array([1 / (len(text) + 201)])))).sum()
        assert lm.probability(codes).sum() + weight == pytest.approx(1, abs=0.02)


def test_without_training_or_rows(spark):
    only = next(i for i in range(100) if held(i))
    (r,) = lm.scores(docs(spark, [(only, "a b")])).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score, r.score) == (0, 0, 3, 0.0, 0.0)
    assert lm.scores(docs(spark, [])).count() == 0
    nothing = lm.scores(docs(spark, [(1, None), (2, ""), (None, None), (2, "")])).collect()
    assert sorted(x.n_tokens for x in nothing) == [1, 1, 1, 1]


def test_documents_that_change_between_reads_are_an_error(spark):
    import random

    from pyspark.sql import functions as F

    changed = F.udf(lambda t: f"{t} {random.SystemRandom().random()}").asNondeterministic()
    table = docs(spark, corpus()).withColumn("text", changed("text"))
    with pytest.raises(Exception, match="differ between two reads"):
        lm.scores(table).collect()


def test_equal_trigrams_of_a_shard_are_looked_up_once(monkeypatch):
    asked, codes = [], lm.Trie.codes
    monkeypatch.setattr(lm.Trie, "codes", lambda self, rank, *rest: asked.append(len(rank)) or codes(self, rank, *rest))
    held = np.arange(30) % 7 == 2
    # In two messages: word 1 alone before 2 in all of 30 documents, 0 and 1 before 0 in one (twice), and before 2 in all.
    docs, times = np.r_[np.arange(30), 5, np.arange(30)], np.r_[np.ones(30, int), 2, np.ones(30, int)]
    grams = [np.array(x) for x in ([1], [2], [0, 1], [1, 2], [2, 0, 2], [30, 1, 30])]
    message = lm.bundle(np.array([1, 3, 5]), np.array([50, 60, 70]), *grams, docs, times, np.packbits(held).astype(int), np.array([30]))
    none = pa.table({"shard": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
    out = lm._summed(pa.table({"shard": [0, 0], "chunk": [7, 8], "data": [message, message]}), none).to_pylist()
    assert sum(asked) == 3
    n = 2 * (~held).sum()
    b, a, c = np.array([1, 1, 1]), np.array([-1, 0, 0]), np.array([2, 0, 2])
    base = np.array([50, 60, 70])
    trie = lm.Trie.built(b, a, c, np.array([n, 4, n]), np.array([1, 4, 9]), base)
    one, two, three = codes(trie, trie.ranks()[b], a, c, base[c])
    want = np.full(30, one + three)
    want[5] += 2 * two
    assert [(x["chunk"], x["header"]) for x in out] == [(7, False), (8, False)]
    for x in out:
        got = np.zeros(30, int)
        doc, sums = lm.unbundle(x["data"])
        got[doc] += sums
        assert got.tolist() == want.tolist()
    for size in (30, 10**6):
        doc, sums = lm._sums(np.array([4, 1, 4]), np.array([3, 5, 6]), size)
        assert (doc.tolist(), sums.tolist()) == ([1, 4], [5, 9])


def test_distinct_values():
    r = np.random.default_rng(2)
    for top in (1, 5, 1000, 1 << 40, (1 << 63) - 1):
        for v in (r.integers(0, top, 3000), np.sort(r.integers(0, top, 3000)), r.integers(0, top, 1), np.zeros(0, np.int64)):
            for got, want in zip(distinct(v), np.unique(v, return_inverse=True)):
                assert got.tolist() == want.tolist()
    # Hashes that differ in the low bits only, in all orders.
    close = (np.uint64(77) << np.uint64(40)) + r.integers(0, 5, 3000).astype(np.uint64)
    for v in (r.integers(0, 1 << 64, 3000, dtype=np.uint64), r.integers(0, 1 << 64, 40, dtype=np.uint64)[r.integers(0, 40, 3000)], close, np.sort(close), close[:1]):
        for got, want in zip(lm._distinct_hashes(v), np.unique(v, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_sequences():
    r = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1), (1, 1 << 40), (1000, 1000), (1000, 10**9), (40_000, 50_000), (3000, 1 << 45)):
        v = np.sort(r.choice(min(top, 10**6), size=n, replace=False).astype(np.int64) * max(1, top // 10**6))
        e = EliasFano.read(iter(EliasFano.of(v, top).arrays()))
        place = {int(x): i for i, x in enumerate(v)}
        for q in (np.r_[v, r.integers(0, top + 5, 500), [-1, top, top + 1]], np.array([0, 1, top // 2])):
            assert EliasFano.read(iter(e.arrays())).find(q).tolist() == [place.get(int(x), -1) for x in q]
        assert (e.values(np.arange(n)) == v).all()
    twice = np.array([3, 3, 3, 9])
    assert (EliasFano.of(twice, 10).values(np.arange(4)) == twice).all()
    for width in (0, 1, 7, 11, 33, 57, 63):
        x = r.integers(0, 1 << width, 999) if width else np.zeros(999, int)
        assert (Packed.of(x, width)[np.arange(999)] == x).all()
    for arrays in ([np.arange(3), np.array([1 << 40]), np.zeros(0, int)], [np.array([2**64 - 1], np.uint64)]):
        for x, y in zip(arrays, lm.unbundle(lm.bundle(*arrays))):
            assert x.tolist() == y.tolist()
