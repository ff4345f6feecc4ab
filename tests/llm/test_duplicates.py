import collections
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.tables import WORD, collected, corpus, docs, prose
from tidemark.llm import exact_dup, near_dup, words
from tidemark.llm.components import components
from tidemark.llm.quotient import QuotientFilter, merged


def test_exact_groups(spark):
    rows = corpus()
    got = collected(exact_dup.exact_groups(docs(spark, rows)))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        expected = (keep, len(ids), keep is None or i == keep, hashlib.sha256((t or "").encode()).hexdigest())
        assert expected in {(r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got[i]}
    assert sum(map(len, got.values())) == len(rows)


def test_exact_dedup_keeps_one_row_and_all_columns(spark):
    rows = corpus()
    table = docs(spark, rows)
    left = exact_dup.exact_dedup(table)
    assert left.columns == table.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t in rows})


def test_fingerprints_that_collide_are_told_apart_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "bb"), (6, "x")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dup.exact_groups(docs(spark, rows)).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (5, 2), 5: (5, 2), 4: (4, 1), 6: (6, 1)}


def test_filters_merge_without_loss():
    r = np.random.default_rng(0)
    values = r.integers(-(2**63), 2**63 - 1, 3000)
    values = np.concatenate([values, values[:500], values[:100]])
    for bits in (0, 3, 9):
        parts = collections.defaultdict(list)
        for part in np.array_split(r.permutation(values), 7):
            batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["_fp"]) for x in np.array_split(part, 3)]
            made = [row for batch in exact_dup._filters(bits)(batches) for row in batch.to_pylist()]
            # One filter of each block for the whole partition.
            assert len({row["block"] for row in made}) == len(made)
            for row in made:
                parts[row["block"]].append(row)
        found = {}
        for rows in parts.values():
            merged = exact_dup._merge(bits)(pa.Table.from_pylist(rows))
            found |= dict(zip(merged.column("_fp").to_pylist(), merged.column("_many").to_pylist()))
        assert found == {v: n for v, n in collections.Counter(values.tolist()).items() if n > 1}


def test_quotient_filters_keep_every_count():
    r = np.random.default_rng(1)
    for bits in (64, 60, 20, 8):
        for n in (0, 1, 2, 5, 100, 5000):
            n = min(n, 1 << (bits - 2))
            values = np.unique((r.integers(0, 2**63, 2 * n + 1, dtype=np.uint64) * np.uint64(2)) >> np.uint64(64 - bits))[:n]
            counts = r.choice([1, 1, 1, 2, 3, 300, 70_000, 5_000_000_000], len(values))
            made = QuotientFilter.of(values, counts, bits)
            again = QuotientFilter.read(bytes(made)).items()
            assert (again[0] == values).all() and (again[1] == counts).all()
            halves = [QuotientFilter.of(values[i::2], counts[i::2], bits) for i in (0, 1)] + [made]
            both = merged(halves).items()
            assert (both[0] == values).all() and (both[1] == 2 * counts).all()
    # Runs that crowd one another: all quotients equal, and remainders that differ in the last bit.
    for values in (np.arange(900, dtype=np.uint64), np.arange(900, dtype=np.uint64) + np.uint64(2**64 - 900)):
        made = QuotientFilter.of(values, np.arange(900) % 5 + 1, 64)
        assert (made.items()[0] == values).all() and (made.items()[1] == np.arange(900) % 5 + 1).all()
    # A fingerprint takes its remainder and three bits, over the load.
    values = np.unique(r.integers(0, 2**60, 49_000, dtype=np.uint64))
    made = QuotientFilter.of(values, np.ones(len(values)), 60)
    assert len(bytes(made)) * 8 <= 1.1 * len(made.occupied) * (60 - made.quotient_bits + 3) and len(values) > 0.5 * len(made.occupied)


def test_unconnected_nodes_meet_only_blocks_that_ask(spark, monkeypatch):
    """One node apart among many of one band value: the others go to one block of askers, once each."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    nodes = spark.range(400).select(
        F.col("id").alias("node"), F.lit(10).cast("long").alias("n_shingles"), F.lit(b"x" * 256).alias("slots"), F.lit(b"y" * 256).alias("marks")
    )
    shared = nodes.select(F.lit(1).cast("long").alias("band"), "node", F.lit(0).cast("long").alias("leader"), F.lit(400).cast("long").alias("members"))
    parts = nodes.where("node != 77").select("node", F.lit(0).cast("long").alias("component"))
    met = near_dup._unconnected(shared, parts, nodes)
    assert met.where("not asks").count() == 399 and met.where("asks").select("node").distinct().collect()[0][0] == 77
    assert met.where("asks").count() == 50 and met.groupBy("first", "second").count().count() == 50


def brute(rows):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            if same_id or shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                parent[root(a)] = root(b)
    out = []
    for a, (i, _) in enumerate(rows):
        own = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(own, default=None) if sets[a] else i))
    return sorted(out, key=repr)


def test_near_duplicates_against_all_pairs(spark):
    rows = corpus()
    chain = prose(50, 100).split()
    for i in range(12):  # each links to the next, the ends do not
        chain[5 + 7 * i] = f"new{i}"
        rows.append((200 + i, " ".join(chain)))
    base = prose(60, 150).split()
    for i in range(40):  # copies of one text, some pairs of which are below the threshold
        copy = list(base)
        for k in range(2):
            copy[(13 * i + 37 * k) % 150] = f"edit{i}{k}"
        rows.append((300 + i, " ".join(copy).upper() if i % 2 else " ".join(copy)))
    got = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)


def test_block_pairs_find_links_that_leaders_miss():
    """Two linked sets beside an unlinked leader: the pair must come out, whatever the blocks."""
    slots = np.random.default_rng(1).integers(0, 256, (3, near_dup.SLOTS), dtype=np.uint8)
    slots[2] = slots[1]
    table = pa.table(
        {
            "node": [5, 6, 7], "component": [5, 6, 7], "n_shingles": [100, 100, 110],
            "asks": [False, True, False], "first": [0, 0, 0], "second": [1, 1, 1], "slots": [s.tobytes() for s in slots],
            "band": [9, 9, 9], "marks": [np.arange(i, i + near_dup.BANDS).tobytes() for i in (5, 9, 9)],
        }
    )
    table = table.append_column("hashes", [[np.arange(i, i + 100, dtype=np.uint64).tobytes() for i in (500, 0, 5)]])
    assert near_dup._likest(table).to_pylist() == near_dup._linked(table).to_pylist() == [{"a": 7, "b": 6}]
    assert near_dup._involved(table).column("node").to_pylist() == [6, 7]
    later = table.set_column(table.column_names.index("band"), "band", [[10, 10, 10]])
    assert near_dup._involved(later).num_rows == near_dup._linked(later).num_rows == 0


def test_sketch_estimates_similarity_and_fills_every_bin():
    r = np.random.default_rng(3)
    for n in (1, 3, 40, 2000):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: n // 5] = r.integers(0, 2**63, n // 5)
        hashes = np.concatenate([np.sort(a), np.sort(b)])
        s = near_dup.sketch(hashes, np.array([0, n, 2 * n]))
        assert (s != near_dup._END).all()
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((s[0] == s[1]).mean() - true) < 0.2


def test_without_near_duplicates(spark):
    rows = corpus()
    table = docs(spark, rows)
    left = near_dup.without_near_duplicates(table)
    assert left.columns == table.columns
    ids = [r.doc_id for r in left.collect()]
    assert {8, 10, 7, 41} & set(ids) == set() and {3, 40, 30, 31, 32, None} <= set(ids)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.without_near_duplicates(empty).count() == 0
    assert exact_dup.exact_groups(empty).count() == 0
    assert exact_dup.exact_dedup(empty).count() == 0


def test_words_in_pieces(monkeypatch):
    texts = ["", "ab cd", " x", None, "longer words here", "y" * 50, "end "]
    data, offsets = words.buffers(pa.array(texts))
    whole = words.Words(data, offsets)
    monkeypatch.setattr(words, "PIECE", 7)
    assert (words.Words(data, offsets).hash == whole.hash).all()
    found = [bytes(whole.data[a:b]).decode() for a, b in zip(whole.starts, whole.ends)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    assert whole.counts().tolist() == [len(WORD.findall(t or "")) for t in texts]
