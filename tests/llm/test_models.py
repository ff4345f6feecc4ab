import random
import time
import zlib

import numpy as np
import pytest

from tests.llm.tables import collected, corpus, docs, prose
from tidemark.llm import html_text, labelled, quality, toxicity


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def labels(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int, extra string")


@pytest.fixture(scope="module")
def toxic_rows():
    r = random.Random(5)
    rows = []
    for i in range(900):
        words = prose(1000 + i, r.randint(10, 80)).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["nastyword", "vilestemmed" + prose(i, 1), "grubby"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark, toxic_rows):
    marks = [(i, y, None) for i, _, y in toxic_rows] + [(5000, None, None), (None, 1, None), (7, 3, None)]
    edge = [(6000, None), (6001, ""), (6002, "nastyword"), (6002, "nastyword"), (None, "grubby nastyword")]
    table = docs(spark, [(i, t) for i, t, _ in toxic_rows] + edge)
    got = collected(toxicity.toxicity(table, labels(spark, marks, "toxic")))
    assert sum(map(len, got.values())) == len(toxic_rows) + len(edge)
    assert all(r.held_out == held(i) for i, own in got.items() for r in own)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for own in got.values() for r in own)
    out = [(y, got[i][0].predicted) for i, _, y in toxic_rows if held(i)]
    assert np.mean([p for y, p in out if y]) > 0.8 and np.mean([p for y, p in out if not y]) < 0.03
    assert got[6000][0].score == got[6001][0].score and got[6002][0].score == got[6002][1].score


def test_labels_of_the_held_out_fold_do_not_matter(spark, toxic_rows):
    table = docs(spark, [(i, t) for i, t, _ in toxic_rows])
    one = labels(spark, [(i, y, None) for i, _, y in toxic_rows], "toxic")
    other = labels(spark, [(i, 1 - y if held(i) else y, None) for i, _, y in toxic_rows], "toxic")
    a, b = (collected(toxicity.toxicity(table, x)) for x in (one, other))
    assert all(a[i][0].score == b[i][0].score for i in a)


def test_without_toxic_keeps_rows_as_they_are(spark, toxic_rows):
    table = docs(spark, [(i, t) for i, t, _ in toxic_rows])
    marks = labels(spark, [(i, y, None) for i, _, y in toxic_rows], "toxic")
    kept = toxicity.without_toxic(table, marks)
    assert kept.schema == table.schema
    predicted = {r.doc_id for r in toxicity.toxicity(table, marks).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == predicted


def test_quality_on_held_out_rows(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        text = prose(3000 + i, r.randint(20, 90))
        if i % 4 == 0:
            text = r.choice([
                " ".join(w for w in text.split() for _ in range(9)),
                " ".join(w.upper() + "!!" for w in text.split()),
                " ".join(w + r.choice(["###", "&&&"]) for w in text.split()),
            ])
        rows.append((i, text, int(i % 4 != 0)))
    edge = [(600, None), (601, ""), (602, "x"), (None, "y"), (603, prose(1, 40_000))]
    table = docs(spark, [(i, t) for i, t, _ in rows] + edge)
    got = collected(quality.quality(table, labels(spark, [(i, y, None) for i, _, y in rows], "quality")))
    assert sum(map(len, got.values())) == len(rows) + len(edge)
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, o in got.items() for r in o)
    out = [(y, got[i][0].predicted) for i, _, y in rows if held(i)]
    assert np.mean([p for y, p in out if y]) > 0.97 and np.mean([p for y, p in out if not y]) < 0.1


@pytest.mark.parametrize("operator, name, alone", [(toxicity.toxicity, "toxic", 0.0), (quality.quality, "quality", 0.5)])
def test_without_labels_or_rows(spark, operator, name, alone):
    table = docs(spark, corpus())
    scores = {round(r.score, 3) for r in operator(table, labels(spark, [], name)).collect()}
    assert scores == {alone}
    one = {round(r.score, 3) for r in operator(table, labels(spark, [(8, 1, None), (10, 1, None)], name)).collect()}
    assert one == {1.0}
    assert operator(docs(spark, []), labels(spark, [], name)).count() == 0


def test_sample_is_bounded_and_counts_are_whole(spark, toxic_rows):
    table = docs(spark, [(i, t) for i, t, _ in toxic_rows])
    marks = labels(spark, [(i, y, None) for i, _, y in toxic_rows], "toxic")
    rows, totals = labelled.chosen(table, marks, "toxic", per_class=20)
    found = rows.collect()
    assert [sum(r.label == y for r in found) for y in (0, 1)] == [20, 20]
    assert sum(totals) == sum(not held(i) for i, _, _ in toxic_rows)
    most = 3 * len(found[0].text.encode())
    less, _ = labelled.chosen(table, marks, "toxic", per_class=20, most_bytes=most)
    sizes = [len(r.text.encode()) for r in less.collect()]
    assert 0 < len(sizes) < 40 and sum(sizes) <= most
    # Rows that share a labelled doc_id give one document.
    again = labelled.chosen(table.unionByName(table).unionByName(docs(spark, [(found[0].doc_id, "other text")])), marks, "toxic", per_class=20)[0]
    assert again.count() == 40


def test_hinge_separates():
    r = np.random.default_rng(0)
    signs = np.where(r.random(200) < 0.5, 1.0, -1.0)
    features = [np.array([0 if s > 0 else 1, 2 + k % 5]) for k, s in enumerate(signs)]
    # Scales are log ratios of the classes, as the method gives them to the fit.
    w, b = quality._trained(features, (signs > 0).astype(int))
    assert all(np.sign(w[x].sum() + b) == s for x, s in zip(features, signs))


def test_blocks_of_broken_markup():
    found = html_text.blocks(
        "<!-- <p>no</p> --><title>t</title><script>var x='<p>no</p>'</script><p>a <b>bold<br>b</b>&nbsp;&amp; c<p>d"
        "<ul><li>e<li><a href='>'>f</a></ul>g</div>h < i<table><tr><td>j<td>k</table>"
    )
    assert [b.text for b in found] == ["a bold b & c", "d", "e", "f", "g", "h < i", "j", "k"]
    assert found[3].linked == 1 and [e.tag for e in html_text._path(found[3].path)] == ["ul", "li"]
    assert html_text.blocks("") == [] and html_text.blocks("<p> </p><!-- open") == []


def texts(page):
    return [b.text for b in html_text.blocks(page)]


def test_no_markup_swallows_what_follows():
    assert texts("<p>a</p><video-player src='x'></video-player><p>b") == ["a", "b"]
    assert texts("<object-view><p>a</p></object-view><title-bar>t</title-bar>") == ["a", "t"]
    assert texts("<p>a<svg viewBox='0'/>b<p>c <button type=b/>d") == ["ab", "c d"]
    assert texts("<p>a<button>press<p>b</p>") == ["a", "b"]
    assert texts("<p>a<button>press</button>c<SVG><p>no</SVG >d") == ["acd"]
    assert texts("<p>a<script>x < y<p>no") == ["a"]
    assert texts("<p>a</p><script>x</scripty></script ><p>b") == ["a", "b"]
    assert texts('<p>a<a href="x>b<p>c') == ["ab", "c"]
    assert texts("<p>1 < 2 <3 & a<b") == ["1 < 2 <3 & a<b"]
    assert texts("<p>a<!doctype x>b<?php c ?>d<!-- e -->f<!") == ["abdf<!"]


@pytest.mark.parametrize(
    "unit", ["<a ", "<a '", '<a ">" ', "<a x='>'\"", "<div>", "<div>x", "</p>", "<li>x", "<button>", "<svg ", "<!--", "<!", "&amp", "<b>x</b>", "<ul><li>x"]
)
def test_pages_of_any_markup_take_linear_time(unit):
    """A megabyte of each; what is quadratic takes hours."""
    page = unit * ((1 << 20) // len(unit))
    begin = time.process_time()
    field = html_text.Field({"in div": 0.1}, [[0.0, 0.0]] * 3)
    for text in (page, page + ">", page + "<p>end</p>"):
        html_text.extract(field, text)
    assert time.process_time() - begin < 60


def test_marginals_against_all_labellings():
    from itertools import product

    r = random.Random(1)
    scores, p = [r.gauss(0, 2) for _ in range(6)], [[r.gauss(0, 1) for _ in range(2)] for _ in range(3)]

    def value(y):
        return p[2][y[0]] + sum(s for s, l in zip(scores, y) if l) + sum(p[a][b] for a, b in zip(y, y[1:]))

    every = {y: np.exp(value(y)) for y in product((0, 1), repeat=6)}
    total = sum(every.values())
    main, counts = html_text.marginals(scores, p)
    for i in range(6):
        assert main[i] == pytest.approx(sum(v for y, v in every.items() if y[i]) / total)
    assert counts[0][1] == pytest.approx(sum(v * sum(a == 0 and b == 1 for a, b in zip(y, y[1:])) for y, v in every.items()) / total)

    class Fixed(html_text.Field):
        def scores(self, page):
            return scores

    assert tuple(Fixed({}, p).labels([])) == max(every, key=every.get)


PAGE = (
    "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
    "<{0}><h1>Title &amp; more</h1><p>First   paragraph,\nwith words.</p><div class='ad'>Buy this now.</div><p>Second one, longer "
    "than the first, ends here.</p></{1}><div id='comments'><p>Great article, thanks for it.</p></div>"
    "<form>Subscribe <input></form><aside>Related things</aside><footer>&copy; 2024 someone</footer></body></html>"
)


def test_main_text(spark):
    rows = [(i, f"u{i}", PAGE.format(*x), "c") for i, x in enumerate((("article",) * 2, ("main",) * 2, ("div class='post-content'", "div")))]
    rows += [(3, None, None, "c"), (4, "u", "", "c"), (None, "u", "<article><p>x.</p></article>", "c"), (0, "u0", rows[0][2], "c")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collected(html_text.main_text(table), "page_id")
    expected = "Title & more\n\nFirst paragraph, with words.\n\nSecond one, longer than the first, ends here."
    assert [got[i][0].text for i in (0, 1, 2)] == [expected] * 3 and len(got[0]) == 2
    assert got[0][0].n_chars == len(expected)
    assert got[3][0].text == got[4][0].text == "" and got[4][0].n_chars == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_text(empty).count() == 0


def test_field_on_unseen_built_pages():
    texts = [prose(i, 30).capitalize() + "." for i in range(60)]
    field = html_text.train(html_text.labelled([PAGE.format("article", "article")] * 3, built=300))
    build = html_text.Builder(texts, ["Home", "News"], 77)
    right = total = 0
    for _ in range(60):
        found, labels = build.page()

        class Given(html_text.Field):
            def scores(self, page):
                return [sum(self.weights.get(f, 0.0) for f in own) for own in found]

        guess = Given(field.weights, field.pairs).labels([])
        right += sum(a == b for a, b in zip(labels, guess))
        total += len(labels)
    assert right / total > 0.93


def test_hinge_reaches_the_least_loss(monkeypatch):
    """No small step away from the weights lowers the regularised hinge loss."""
    monkeypatch.setattr(quality, "PASSES", 600)
    monkeypatch.setattr(quality, "BETA", 1.0)
    r = np.random.default_rng(2)
    signs = np.where(r.random(60) < 0.5, 1.0, -1.0)
    features = [np.unique(np.r_[r.integers(0, 9, 4), 0 if s > 0 and r.random() < 0.8 else 1]) for s in signs]
    scale = r.normal(size=9)
    w, b = quality.hinge(features, scale, signs)
    w = w / scale

    def loss(w, b):
        margins = np.array([w[x] @ scale[x] + b for x in features])
        return 0.5 * (w @ w + b * b) + quality.COST * np.maximum(0, 1 - signs * margins).sum()

    least = loss(w, b)
    for size in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            step = size * r.normal(size=10)
            assert loss(w + step[:9], b + step[9]) >= least - 1e-6


def test_mean_size_is_added_to_seen_indicators(monkeypatch):
    scale = np.array([1.5, -2.0, 0.0, 0.5])
    signs = np.array([1.0, -1.0])
    features = [np.array([0, 3]), np.array([1, 3])]
    monkeypatch.setattr(quality, "BETA", 1.0)
    plain, _ = quality.hinge(features, scale, signs)
    monkeypatch.setattr(quality, "BETA", 0.25)
    mixed, _ = quality.hinge(features, scale, signs)
    own = plain[[0, 1, 3]] / scale[[0, 1, 3]]
    assert np.allclose(mixed[[0, 1, 3]], (0.25 * own + 0.75 * np.abs(own).mean()) * scale[[0, 1, 3]]) and mixed[2] == 0


def test_ftrl_against_a_plain_loop():
    r = np.random.default_rng(4)
    labels = (r.random(80) < 0.4).astype(np.int8)
    features = [np.unique(np.r_[r.integers(10, 200, 6), 3 if y and r.random() < 0.9 else 5]) for y in labels]
    weights, intercept = toxicity.fit(labelled.Sample(features, labels, (600, 200)))
    z, n, b_z, b_n, b = {}, {}, 0.0, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(toxicity.EPOCHS):
        for k in labelled.shuffled(len(labels), epoch):
            own = {int(i): weight(int(i)) for i in features[k]}
            g = 1 / (1 + np.exp(-(sum(own.values()) + b))) - labels[k]
            for i, w in own.items():
                rate = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - rate * w
                n[i] = n.get(i, 0.0) + g * g
            rate = ((b_n + g * g) ** 0.5 - b_n**0.5) / toxicity.ALPHA
            b_z, b_n = b_z + g - rate * b, b_n + g * g
            b = -b_z / ((toxicity.BETA + b_n**0.5) / toxicity.ALPHA)
    want = np.zeros(toxicity.BUCKETS)
    for i in z:
        want[i] = weight(i)
    assert np.allclose(weights, want) and 0 < (weights != 0).sum() < 0.5 * len(z)
    ones = labels.sum()
    assert intercept == pytest.approx(b + np.log((200 / ones) / (600 / (80 - ones))))


def test_a_very_long_text_is_scored_whole(spark, toxic_rows):
    table = docs(spark, [(i, t) for i, t, _ in toxic_rows])
    marks = labels(spark, [(i, y, None) for i, _, y in toxic_rows], "toxic")
    weights, intercept = labelled.fitted(table, marks, "toxic", toxicity.extract, toxicity.BUCKETS, toxicity.fit)
    bad = next(t for _, t, y in toxic_rows if y)
    long = prose(9, 200_000)
    scores = collected(toxicity.score(docs(spark, [(1, long), (2, f"{long} {bad}"), (3, f"{bad} {long}"), (4, bad)]), weights, intercept))
    assert scores[2][0].score != scores[1][0].score and scores[4][0].score > 0.5
    doc, number = toxicity.extract(np.frombuffer(f"{long} {bad}".encode(), np.uint8), np.array([0, len(f"{long} {bad}".encode())]))
    assert scores[2][0].score == pytest.approx(float(labelled.sigmoid(weights[np.unique(number)].sum() + intercept)), abs=1e-9)
