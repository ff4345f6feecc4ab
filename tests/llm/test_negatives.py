import json
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives
from tidemark.llm.queries import SQL

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block string, chunk string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y", None) for i, v, y in rows], SCHEMA)


def cloud(n, seed=1, width=6, labels=10):
    """Rows around a few centres, so that nodes split and positives score high."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, width))
    x = centres[r.integers(0, 5, n)] + 0.4 * r.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in x[i].astype(np.float32)], int(r.integers(0, labels))) for i in range(n)]


def brute(rows):
    kept = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    anchors = {(i, tuple(v), y) for i, v, y in kept if i % 100 == 0}
    for i, v, y in anchors:
        others = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in kept if j != i]
        for s, j, _ in sorted(x for x in others if x[2] == y)[:5]:
            fits = sorted(x for x in others if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def mined(table):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, negatives.hard_negatives(table).select(columns).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, monkeypatch, seed):
    """Deep trees, many blocks and chunks; bounds of a small sample."""
    for name, value in (("SAMPLE", 150), ("FANOUT", 4), ("CELL", 40), ("BLOCK", 25), ("CHUNK", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = cloud(900, seed)
    assert mined(vectors(spark, rows)) == brute(rows)
    made = negatives.index(negatives.usable(vectors(spark, rows)))
    assert len(made.tree.points) > 1 and made.blocks.sum() > 30
    assert sum(int(r.rows.sum()) for r in made.ranges[:1]) == 900
    assert made.table.agg(F.sum("n")).first()[0] == 900


def test_ranges_leave_subtrees_out(spark, monkeypatch):
    """Far clusters are not looked at, and no row of a window is lost by that."""
    monkeypatch.setattr(negatives, "CELL", 30)
    r = np.random.default_rng(3)
    x = np.concatenate([np.round(c + r.normal(size=(80, 3)) * 3).astype(np.int64) for c in ([0, 0, 900], [900, 0, 0], [0, 900, 0], [-600, -600, 0])])
    tree = negatives.Tree.grown(x, len(x))
    ranges = [negatives.Ranges.empty(len(p)) for p in tree.points]
    cell = tree.routed(x, ranges)
    q = x[::20]
    scores = q @ x.T
    low, high = np.sort(scores, 1)[:, -10:-9], np.sort(scores, 1)[:, -3:-2]
    reached = tree.reached(ranges, q, low, high)
    inside = (scores >= low) & (scores <= high)
    assert all(reached[a, cell[b]] for a, b in zip(*np.nonzero(inside)))
    assert reached.mean() < 0.5


def test_awkward_rows(spark):
    rows = cloud(260, 5)
    v = rows[0][1]
    rows += [(300, None, 1), (301, v, None), (302, [*v[:-1], None], 1), (303, [*v[:-1], float("nan")], 1), (304, [*v[:-1], float("inf")], 2)]
    rows += [(None, v, 1), (400, v[:3], 1), (401, [], 2), (402, [*v, 0.5], 3), (100, v, 4), (7, v, 4), (7, v, 4), (500, v, 1), (500, v, 1)]
    rows += [(1000 + i, v, i % 3) for i in range(60)]
    assert mined(vectors(spark, rows)) == brute(rows)
    large = [(i, [1e5 if i == 3 else 6e4, 1.0], i % 2) for i in range(0, 300, 50)] + [(3, [1e5, 1.0], 0)]
    got = mined(vectors(spark, large))
    assert got == brute([r for r in large if r[0] != 3]) and all(3 not in x[:4] for x in got)
    assert mined(vectors(spark, [])) == [] == mined(vectors(spark, [(1, v, 1), (2, v, 2)]))


def test_narrow_arithmetic_does_not_round():
    r = random.Random(2)
    for top in (100, 1 << 12, 1 << 24):
        a, b = (np.array([[r.randint(-top, top) for _ in range(40)] for _ in range(20)]) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert negatives.dots(a, b).tolist() == want


def test_against_sql(spark):
    rows = cloud(700, 8, width=16)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert mined(vectors(spark, rows)) == sorted(con.execute(SQL["op11_hard_negatives"]).fetchall())


def test_groups_panels_and_turns(spark, monkeypatch):
    """Blocks that wait for the bounds of others, several groups of anchors, rows of one score."""
    small = {"SAMPLE": 150, "FANOUT": 4, "CELL": 60, "BLOCK": 15, "CHUNK": 2, "GROUP": 4, "PANEL": 60, "PANELS": 4, "FIRST": 2}
    for name, value in small.items():
        monkeypatch.setattr(negatives, name, value)
    rows = cloud(900, 4)
    rows += [(1000 + i, rows[i % 40][1], i % 4) for i in range(300)] + [(1300 + i % 3, rows[5][1], 7) for i in range(9)]
    assert mined(vectors(spark, rows)) == brute(rows)
    made = negatives.index(negatives.usable(vectors(spark, rows)))
    assert set(made.turn) == {0, 1} and made.panel[made.turn == 1].max() > 3
    assert negatives._groups(made, 7, 2, False) == 4 and negatives._groups(made, 7, 2, True) == 2


def test_chunks_and_blocks_are_not_joined(spark):
    """A join copies the vectors of both for each pair of them, anchors times rows."""
    plan = json.loads(negatives.hard_negatives(vectors(spark, cloud(300)))._jdf.queryExecution().optimizedPlan().toJSON())
    joins = [i for i, node in enumerate(plan) if node["class"].endswith(".Join")]

    def below(i):
        """Names of the columns under node i of a plan that lists nodes before their children."""
        names, left = set(re.findall(r'"name": "(\w+)"', json.dumps(plan[i].get("output") or plan[i].get("projectList") or []))), i + 1
        for _ in range(plan[i]["num-children"]):
            more, left = below(left)
            names |= more if plan[i]["class"].endswith((".Join", ".Filter")) else set()
        return names, left

    assert joins and not any("vectors" in below(i)[0] for i in joins)


def of_group(rows, anchors, low, high, same, k, fanout, size):
    """The lists of one group of anchors that meets blocks one by one: (anchor, window, vec_id, score)."""
    x, ids, labels = rows
    a = negatives._chunk_row(0, ids[anchors], labels[anchors], x[anchors], np.zeros((len(anchors), 1), np.int64), low, high).to_pylist()[0]
    a["number"], a["reached"] = a.pop("chunk"), np.packbits(np.ones((len(anchors), 1), bool)).tobytes()
    group = negatives._Group([a], 1, same, k)
    for b in range(0, len(x), size):
        part = slice(b, b + size)
        table = {"block": [0] * len(ids[part]), "vec_id": ids[part], "label": labels[part], "vector": list(x[part].astype(np.int32))}
        group.meet(negatives._built([0], [0])(pa.table(table)).to_pylist()[0], 0)
    found = group.found()
    owner, i, s = negatives._hits(found.to_pylist()[0])
    return sorted(zip((owner // low.shape[1]).tolist(), (owner % low.shape[1]).tolist(), i.tolist(), s.tolist()))


@pytest.mark.parametrize("top, width", [(1, 12), (1 << 13, 12), (1 << 24, 40)])
@pytest.mark.parametrize("same", [True, False])
def test_lists_of_a_group(monkeypatch, top, width, same):
    """Products in every arithmetic, in small tiles, with leaves left out where clusters are far apart."""
    monkeypatch.setattr(negatives, "TILE", (5, 16))
    monkeypatch.setattr(negatives, "FANOUT", 4)
    r = np.random.default_rng(6)
    centres = r.integers(-60, 61, (4, width)) * top
    x = (centres[np.arange(1200) % 4] + r.integers(-3, 4, (1200, width)) * top).clip(-top * 64, top * 64) // (64 if top == 1 << 24 else 1)
    ids, labels = np.arange(1200) % 1150, np.arange(1200) // 4 % 3
    anchors = np.arange(0, 1200, 31)
    scores = x[anchors] @ x.T
    ordered = np.sort(scores, axis=1)
    low, high = ordered[:, [-900, -120, -40]], ordered[:, [-860, -30, -60]]
    got = of_group((x, ids, labels), anchors, low, high, same, 6, 4, 400)
    want = []
    for a, at in enumerate(anchors):
        for w in range(3):
            fits = [(-int(s), int(i)) for s, i, y in zip(scores[a], ids, labels) if (y == labels[at]) == same and i != ids[at] and low[a, w] <= s <= high[a, w]]
            want += [(a, w, i, -s) for s, i in sorted(fits)[:6]]
    assert got == sorted(want) and len(got) > 100


def test_packed_rows_are_whole():
    r = np.random.default_rng(7)
    for low, high in ((0, 1), (-3, 4), (-128, 128), (-300, 20), (-(1 << 24), 1 << 24)):
        x = r.integers(low, high, (9, 5))
        assert negatives._unpacked(negatives._packed(x), 9, 5).tolist() == x.tolist()
    assert negatives._unpacked(negatives._packed(np.zeros((3, 0), np.int64)), 3, 0).shape == (3, 0)
