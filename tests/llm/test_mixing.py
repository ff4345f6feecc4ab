import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import WORD, collected, corpus, docs, prose
from tidemark.llm import mixing
from tidemark.llm.queries import SQL


def plain_targets(sizes):
    """Shares by weight; what lies over the cap is shared again until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, budget = {}, set(names), sum(sizes.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            budget -= out[s]
        free -= over
    return out


def rows_of(n, seed=4):
    r = random.Random(seed)
    names = ["a"] * 30 + ["b"] * 6 + ["c", "d", None, "Z", "é"]
    return [(i, prose(i, min(4000, int(r.paretovariate(0.9) * 12))), r.choice(names)) for i in range(n)]


def test_targets_and_words(spark):
    rows = rows_of(1500)
    got = collected(mixing.mix_sizes(docs(spark, rows)))
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    expected = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for i, t, s in rows:
        r = got[i][0]
        assert r.size == len(WORD.findall(t)) and r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
        assert r.taken == r.copies * r.size <= 3 * r.size
        assert r.copies >= int(expected[s] / sizes[s] - 1e-9)
        taken[s] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(expected[s], rel=0.03), s


def test_bins_do_not_matter(spark, monkeypatch):
    table = docs(spark, rows_of(300))
    one = collected(mixing.mix_sizes(table))
    monkeypatch.setattr(mixing, "BIN_ROWS", 5)
    other = collected(mixing.mix_sizes(table))
    assert {i: r[0].copies for i, r in one.items()} == {i: r[0].copies for i, r in other.items()}


def test_ranks_follow_inclusion_odds(spark):
    """Documents with twice the weight are taken about twice as often."""
    rows = [(i, "w " * 10, "a") for i in range(3000)] + [(9000 + i, "w " * 10, "b") for i in range(900)]
    weight = F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(1.0)
    got = mixing.mix_sizes(docs(spark, rows), weight=weight, share=0.3).where("source = 'a'").collect()
    even, odd = (np.mean([r.copies for r in got if r.doc_id % 2 == k]) for k in (0, 1))
    assert even / odd == pytest.approx(2, rel=0.15)


def test_seed_changes_the_sample_and_reruns_agree(spark):
    table = docs(spark, rows_of(200))
    runs = [{r.doc_id: r.copies for r in mixing.mix_sizes(table, seed=s).collect()} for s in ("mix", "mix", "other")]
    assert runs[0] == runs[1] != runs[2]


def test_mixed_rows_stand_as_often_as_taken(spark):
    table = docs(spark, rows_of(200))
    mix = mixing.mixed(table)
    assert mix.columns == table.columns
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in mixing.mix_sizes(table).collect() if r.copies}


def test_awkward_rows(spark):
    rows = corpus()
    got = mixing.mix_sizes(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r.taken for r in got if not r.size} == {0}
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), rel=0.01)
    nulls = docs(spark, [(None, None, None), (1, None, "a")])
    assert [(r.size, r.taken) for r in mixing.mix_sizes(nulls).collect()] == [(0, 0), (0, 0)]
    assert mixing.mix_sizes(docs(spark, [])).count() == 0 == mixing.mixed(docs(spark, [])).count()


def by_sql(rows):
    """The registered SQL over rows (doc_id, text, source), as sorted texts."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(map(repr, con.execute(SQL["op5_mixing"]).fetchall()))


@pytest.mark.parametrize("twelve", [7, None])
def test_repeated_rows_at_the_cut(spark, twelve):
    """Equal rows are taken one by one: as many as fit, and one as the filler."""
    for seed in range(4):
        rows = rows_of(60, seed)
        rows += [(twelve, "five words in a row", "a")] * 12 + [(5000, "word " * 40, "b")] * 9 + [(6000, None, "b")] * 3
        table = docs(spark, rows)
        got = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.mix_sizes(table).collect()]
        want = by_sql(rows)
        assert [x.split(",")[:4] + x.split(",")[5:] for x in sorted(map(repr, got))] == [x.split(",")[:4] + x.split(",")[5:] for x in want]
        copies = {}
        for r in mixing.mix_sizes(table).collect():
            copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
        counts = {r.doc_id: r["count"] for r in mixing.mixed(table).groupBy("doc_id").count().collect()}
        assert counts == {i: n for i, n in copies.items() if n}
