"""Near duplicates: fast similarity sketching, banding, exact verification, components.

A document's set holds the hashes of its distinct shingles of five lower-cased words (fewer words: the whole
sequence as one).  The sketch has SLOTS bins.  In round i every shingle falls into one bin by the i-th hash,
and a bin keeps its first arrival, rounds before values; SLOTS rounds of free placement are followed by SLOTS
rounds that aim at one bin each, so every bin of a non-empty set is filled.  Documents that agree on one of
BANDS bands of ROWS bins are candidates: at similarity 0.75 a pair is missed with probability
(1 - 0.75^4)^32 = 5e-6.

Equal sets are one node.  Pairs are confirmed on full sets, after a look at sizes and whole sketches, in three
rounds: nodes of one band value with its smallest node; then nodes outside the value's largest component with
their likest partners of other components; then these nodes with all partners of other components.  Nodes that
are connected already are not compared, so a large group of copies costs about one pair per copy.  The last two
rounds compare blocks of sketches inside tasks.  The full round sends the sets of blocks, not pairs, looks at a pair
in the first band that both share only, and returns links alone.  No bucket is cut.

Nulls and empty texts have an empty set and are linked with nothing.  Rows that repeat a doc_id count as one
document for links.  A null doc_id gets the smallest id of its component, or null.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.words import Words, buffers, grams, lean, mix, slices
from tidemark.sources.sinks import staged

SHINGLE = 5
SLOTS, BANDS, ROWS = 256, 32, 4
#: A pair at the threshold agrees on 192 of 256 bins on average (deviation 6.9); fewer than AGREE have odds of 2e-6.
AGREE = 160
BLOCK = 256
#: Likest partners that a node tries in the round before the full one.
FIRST_TRIES = 3
_END = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some documents, ordered by document and hash, and where each begins."""
    words = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    counts = words.counts()
    hashes = grams(words.hash, SHINGLE)
    if len(hashes):
        whole = words.doc[: len(hashes)] == words.doc[SHINGLE - 1 :]
        hashes, doc = hashes[whole], words.doc[: len(whole)][whole]
    else:
        doc = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = np.cumsum(counts) - counts
        ones = [grams(words.hash[first[d] : first[d] + counts[d]], counts[d], salt=100 + counts[d])[0] for d in short]
        hashes, doc = np.concatenate([hashes, np.array(ones, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(n + 1))


def sketch(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sketches of the sets hashes[bounds[i]:bounds[i + 1]]; empty sets have all ones."""
    n = len(bounds) - 1
    out = np.full((n, SLOTS), _END, np.uint64)
    todo = np.flatnonzero(np.diff(bounds))
    for i in range(2 * SLOTS):
        if not len(todo):
            break
        sizes = bounds[todo + 1] - bounds[todo]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(bounds[todo] - (ends - sizes), sizes)
        value = mix(hashes[place], 7 + i)
        # The round goes into the top bits, so an earlier round always wins.
        slot = (value % np.uint64(SLOTS)).astype(np.int64) if i < SLOTS else np.full(len(value), i - SLOTS)
        value = (np.uint64(i) << np.uint64(55)) | (value >> np.uint64(9))
        np.minimum.at(out.reshape(-1), np.repeat(todo, sizes) * SLOTS + slot, value)
        todo = todo[(out[todo] == _END).any(axis=1)]
    return out


def _sketched(batches):
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in slices(offsets):
            hashes, bounds = shingles(data, offsets[i : j + 1])
            n = np.diff(bounds)
            slots = sketch(hashes, bounds)
            bands = grams_of_rows(slots)
            low = _sums(mix(hashes, 901), bounds)
            high = _sums(mix(hashes, 902), bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    pa.array(n, pa.int64()),
                    pa.array(low.view(np.int64)),
                    pa.array(high.view(np.int64)),
                    pa.array([x.tobytes() for x in (mix(slots) & np.uint64(255)).astype(np.uint8)], pa.binary()),
                    pa.array([x.tobytes() for x in bands], pa.binary()),
                    pa.array(bands.view(np.int64).tolist(), pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "low", "high", "slots", "marks", "bands"],
            )


def grams_of_rows(slots: np.ndarray) -> np.ndarray:
    parts = slots[:, : BANDS * ROWS].reshape(len(slots), BANDS, ROWS)
    out = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r], 31 + r)
    return mix(out + np.arange(BANDS, dtype=np.uint64), 77)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _sets(batches):
    """The sets themselves, as bytes of sorted 64-bit hashes."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in slices(offsets):
            hashes, bounds = shingles(data, offsets[i : j + 1])
            parts = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(i, j - i), pa.array(parts, pa.binary())], ["node", "hashes"]
            )


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, given as distinct hashes, reach the threshold."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= 75 * (len(x) + len(y) - shared)


def _confirmed(batches):
    for batch in batches:
        sides = zip(batch.column("left"), batch.column("right"))
        keep = [similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair)) for pair in sides]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _full_sets(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """node, hashes (the set) of the nodes in `ends`."""
    ends = staged(ends, "ends")
    texts = docs.join(ends, docs["doc_id"] == ends["node"]).select("node", "text")
    return staged(texts.mapInArrow(lean(_sets), "node long, hashes binary"), "sets")


def _confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose full sets reach the threshold."""
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs)
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    whole = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return whole.mapInArrow(lean(_confirmed), "a long, b long").distinct()


def _alike(batches):
    """Pairs whose sizes and sketches may reach the threshold."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("x", "y"))
        n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
        fit = ((x == y).sum(axis=1) >= AGREE) & (100 * np.minimum(n, m) >= 75 * np.maximum(n, m))
        yield batch.select(["a", "b"]).filter(pa.array(fit))


class _Meeting:
    """Nodes of one band value: a block of those that are not connected, which ask, and a block of all."""

    def __init__(self, table: pa.Table):
        self.node, self.part, self.n = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
        self.asks = table.column("asks").to_numpy(zero_copy_only=False)
        self.band = table.column("band")[0].as_py()
        self.slots = np.frombuffer(b"".join(table.column("slots").to_pylist()), np.uint8).reshape(-1, SLOTS)
        self.bands = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.int64).reshape(-1, BANDS)

    def partners(self, once: bool):
        """(row, rows that may reach the threshold with it, the likest first); once: only in the first shared band."""
        right = np.flatnonzero(~self.asks)
        for i in np.flatnonzero(self.asks):
            fit = right[(self.part[right] != self.part[i]) & (self.node[right] != self.node[i])]
            fit = fit[100 * np.minimum(self.n[fit], self.n[i]) >= 75 * np.maximum(self.n[fit], self.n[i])]
            agree = (self.slots[fit] == self.slots[i]).sum(axis=1)
            fit, agree = fit[agree >= AGREE], agree[agree >= AGREE]
            if once and len(fit):
                here = self.bands[i][(self.bands[fit] == self.bands[i]).argmax(axis=1)] == self.band
                fit, agree = fit[here], agree[here]
            if len(fit):
                yield i, fit[np.argsort(-agree, kind="stable")]


def _pairs(a: list, b: list) -> pa.Table:
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _likest(table: pa.Table) -> pa.Table:
    met, a, b = _Meeting(table), [], []
    for i, fit in met.partners(once=False):
        b += met.node[fit[:FIRST_TRIES]].tolist()
        a += [met.node[i]] * len(fit[:FIRST_TRIES])
    return _pairs(a, b)


def _involved(table: pa.Table) -> pa.Table:
    """Rows of nodes that have a partner to be confirmed here."""
    needed = np.zeros(table.num_rows, bool)
    for i, fit in _Meeting(table).partners(once=True):
        needed[i] = True
        needed[fit] = True
    return table.filter(pa.array(needed))


def _linked(table: pa.Table) -> pa.Table:
    """Links that connect components, confirmed on full sets; what a link has connected is not looked at again."""
    met, a, b = _Meeting(table), [], []
    sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    for i, fit in met.partners(once=True):
        for j in fit:
            left, right = root(int(met.part[i])), root(int(met.part[j]))
            if left != right and similar(sets[i], sets[j]):
                parent[left] = right
                a.append(met.node[i])
                b.append(met.node[j])
    return _pairs(a, b)


_MET = (
    "band long, first long, second long, asks boolean, node long, component long, n_shingles long, "
    "slots binary, marks binary"
)


def _unconnected(shared: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of band values with several components, dealt to pairs of blocks (columns of _MET).

    Nodes outside the largest component ask; they fill blocks of their own, and only these meet every block of
    the band value, so a value with few such nodes is copied as often as they have blocks.
    """
    rest = shared.where("members > 2 and node != leader").join(parts, "node", "left")
    rest = rest.select("band", "node", F.coalesce("component", "node").alias("component"))
    counts = rest.groupBy("band", "component").agg(F.count("*").alias("n"))
    apart = counts.groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("most"),
        F.sum("n").alias("all"),
        F.max("n").alias("largest"),
        F.count("*").alias("kinds"),
    )
    blocks = [F.ceil(n / BLOCK) for n in (F.col("all") - F.col("largest"), F.col("all"))]
    apart = apart.where("kinds > 1").select("band", "most", blocks[0].alias("asking"), blocks[1].alias("blocks"))
    apart = staged(apart, "apart")
    rest = (
        rest.join(apart, "band")
        .withColumn("minor", F.col("component") != F.col("most"))
        .withColumns({"asker": F.pmod(F.xxhash64("node"), "asking"), "own": F.pmod(F.xxhash64("node"), "blocks")})
        .join(nodes.select("node", "n_shingles", "slots", "marks"), "node")
    )

    def places(count: str):
        return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)

    def meeting(asks: bool, first, second):
        return F.struct(first.alias("first"), second.alias("second"), F.lit(asks).alias("asks"))

    asked = F.transform(places("asking"), lambda i: meeting(False, i, F.col("own")))
    asking = F.transform(places("blocks"), lambda i: meeting(True, F.col("asker"), i))
    at = F.when(F.col("minor"), F.concat(asking, asked)).otherwise(asked)
    return rest.withColumn("at", F.explode(at)).select(
        "band", "at.first", "at.second", "at.asks", "node", "component", "n_shingles", "slots", "marks"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `docs(doc_id, text)`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, low long, high long, slots binary, marks binary, bands array<long>"
    made = staged(docs.mapInArrow(lean(_sketched), schema), "sketches")

    sets = ["low", "high", "n_shingles"]
    known = made.where("n_shingles > 0 and doc_id is not null")
    nodes = known.groupBy(*sets).agg(
        F.min("doc_id").alias("node"), F.min_by(F.struct("slots", "marks", "bands"), "doc_id").alias("x")
    )
    nodes = staged(nodes.select("node", "n_shingles", "x.*", *sets[:2]), "nodes")
    # A doc_id that repeats with another text belongs to two sets, and so links them.
    repeated = known.select("doc_id", *sets).join(nodes.select(*sets, "node"), sets).where("doc_id != node")
    repeated = repeated.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    placed = nodes.select("node", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("members"))
    buckets = staged(buckets.where("members > 1"), "buckets")
    shared = staged(placed.join(buckets, "band").select("band", "node", "leader", "members"), "shared")
    stars = shared.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    looks = nodes.select("node", "n_shingles", "slots")
    stars = stars.join(looks.toDF("a", "n", "x"), "a").join(looks.toDF("b", "m", "y"), "b")
    stars = staged(stars.select("a", "b", "n", "m", "x", "y").mapInArrow(lean(_alike), "a long, b long"), "stars")
    ties = _confirm(stars, docs).unionByName(repeated)
    parts = staged(components(ties), "parts")

    def joined(found: DataFrame) -> DataFrame:
        links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
        return staged(components(links), "parts")

    meeting = ["band", "first", "second"]
    likest = _unconnected(shared, parts, nodes).groupBy(*meeting).applyInArrow(_likest, "a long, b long").distinct()
    parts = joined(_confirm(staged(likest.join(stars, ["a", "b"], "left_anti"), "likest"), docs))
    involved = staged(_unconnected(shared, parts, nodes).groupBy(*meeting).applyInArrow(_involved, _MET), "involved")
    whole = involved.join(_full_sets(involved.select("node").distinct(), docs), "node")
    found = whole.select(*involved.columns, "hashes").groupBy(*meeting).applyInArrow(_linked, "a long, b long")
    parts = joined(found)

    classes = nodes.join(parts, "node", "left").select(*sets, F.coalesce("component", "node").alias("component"))
    out = made.select("doc_id", *sets).join(classes, sets, "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that near_duplicates does not keep, all columns kept.

    Rows with a null doc_id, and rows without words, always stay.
    """
    dropped = near_duplicates(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_drop"], "left_anti")
