import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.tables import corpus, docs, prose
from tidemark.llm import spelling

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def counted(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_error(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(n):
    near = {w: [v for v in n if v != w and one_error(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def got(spark, rows):
    found = spelling.variants(docs(spark, rows)).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    assert len(out) == len(found)
    return out


def misspelt(seed, words=25):
    """Words in very different numbers, with slips of every kind, chains of them, and long words."""
    r = random.Random(seed)
    letters = "abcdeé"
    out = []
    for _ in range(words):
        w = "".join(r.choice(letters) for _ in range(r.choice((7, 7, 8, 9, 13, 40))))
        n = r.choice((600, 60, 12))
        while n >= 2:
            out += [w] * n
            k = r.randrange(len(w))
            w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :], w + w[-1], w[0] + w))
            n = n // r.choice((3, 10, 12))
    r.shuffle(out)
    return [(i, " ".join(x.title() if i % 3 else x for x in out[i::40])) for i in range(40)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rows = misspelt(seed) + corpus() + [(900, "a" * 7 + " " + "a" * 8), (901, "a" * 7 + " " + "a" * 8 + " " + "a" * 9), (902, "a" * 9)]
    rows += [(950 + i, "ÀÉÎÕÜßñ àéîõüßñ ÀÉÎÕÜßn×÷ " + "x" * 5000 + " " + "x" * 5001) for i in range(4)]
    want = brute(counted(rows))
    assert sum(x[0] is not None for x in want.values()) > 5
    assert got(spark, rows) == want


def test_full_groups_are_halved(spark, monkeypatch):
    """Many words that agree but for a few letters; one key would hold them all."""
    r = random.Random(4)
    words = ["common" + "".join(r.choice("abc") for _ in range(5)) for _ in range(250)]
    rows = [(i, " ".join(w for k, w in enumerate(words) for _ in range(1 + 40 * (k % 9 == 0)))) for i in range(3)]
    want = brute(counted(rows))
    monkeypatch.setattr(spelling, "GROUP", 6)
    monkeypatch.setattr(spelling, "BUCKET_ROWS", 50)
    assert got(spark, rows) == want
    table = spark.createDataFrame([(w, 2) for w in set(words)], "word string, n long")
    sizes = spelling.groups(table).groupBy("key", "a", "b").count().collect()
    assert all(x["count"] <= 6 or x["b"] - x["a"] <= 1 for x in sizes)


def test_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(prose(i, 5) for i in range(400)) + " " + "z" * 900 + "é" * 50 + " end"
    whole = Counter(re.findall("[A-Za-zÀ-ÿ]+", text))
    monkeypatch.setattr(spelling, "PIECE", 64)
    assert sum((Counter(re.findall("[A-Za-zÀ-ÿ]+", p)) for p in spelling.pieces(text)), Counter()) == whole
    assert "".join(spelling.pieces(text)) == text and max(map(len, spelling.pieces(text))) > 900


def test_sets_of_a_lane_against_pairs():
    r = random.Random(6)
    for t in (3, 7, 70):
        words = sorted({"".join(r.choice("ab") for _ in range(t + r.randint(0, 1))) for _ in range(150)})
        n = np.array([r.randint(1, 99) for _ in words])
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        words, n = [words[i] for i in order], n[order]
        span = np.zeros(len(words), np.int64), np.full(len(words), t + 1)
        hit, near, best = spelling._compared(words, n, np.zeros(len(words), np.int64), span, t)
        want = {w: [v for v in words if v != w and one_error(w, v) and min(len(v), len(w)) == t] for w in words}
        assert {words[i]: k for i, k in zip(hit, near)} == {w: len(v) for w, v in want.items() if v}
        assert all(words[b] == want[words[i]][0] for i, b in zip(hit, best))


def test_nothing(spark):
    assert got(spark, []) == {} == got(spark, [(1, None), (2, ""), (3, "short words")])
    (only,) = got(spark, [(1, "singular"), (2, "singular singular")]).items()
    assert only == ("singular", (None, "singular", 3, 0, None))
