"""Hard negatives by a multiway hyperplane tree whose split points keep distance ranges to sibling subtrees.

The upper tree is grown on SAMPLE rows (a documented bound): a node's split points are far apart, a row belongs to
the nearest one, and nodes with many rows ahead split again.  Every row of the table is then routed; for each
split point i and sibling j the node keeps the least and greatest distance from i to the rows of j, over all rows.
Rows of a cell are dealt to blocks of about BLOCK rows, so a cell of any size is spread; a block has a node of its
own with the same kind of ranges, and its leaves hold the quantised vectors, which are compared exactly.

Anchors search in chunks, and a task holds a group of chunks against a panel of blocks that pass by one after the
other, so rows move once for each group and anchors once for each panel.  A window of scores, with the norms of a
subtree, is an annulus of distances around the anchor; a sibling j is left out when the ranges of some split point show
that it does not meet the annulus.  Leaves of a block are asked only where a few anchors show that it saves work; what
remains are matrix products, whose scores are held against one bound an anchor.  The sample gives first bounds: the row
that ends its top list is a real row, so the true list begins no lower.  An eighth of each cell's blocks goes first, and
its lists are bounds for the other blocks.  The first search finds the positives, of which an anchor meets rows of its
own label only, the second the negatives inside each positive's window.  Nothing is estimated.

Components x become floor(256 * x).  Rows with a null vec_id, label or vector, or with a component that is null, not
finite or beyond 65,536 take no part (scores of larger ones would not fit a long; up to 2,048 components do).  Shorter
vectors count as padded with zeros.  An empty table, or one without anchors, gives no rows.  Rows that repeat a
vec_id are rows of their own as positives and negatives, never partners of an anchor with that vec_id; equal anchors
search once.  Ties go to the smaller vec_id.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import released, staged

SCALE = 256
LARGEST = 1 << 24
SAMPLE = 4096
FANOUT = 16
#: Rows that a cell of the upper tree holds, about, before it splits; rows of a block; anchors of a chunk.
CELL, BLOCK, CHUNK = 8192, 2048, 256
#: Anchors and rows of one task of a search, and components of either, at most; anchors and rows of one product.
GROUP, PANEL, GROUP_SIZE, PANEL_SIZE, TILE = 1 << 16, 1 << 18, 1 << 22, 1 << 24, (2048, 256)
#: Panels that blocks are cut into, if there are as many.  With more blocks than that, one in FIRST goes first, in as
#: few panels as there can be, since lists begin anew in each; GROUPS of anchors at most make up for that.
PANELS, FIRST, GROUPS = 64, 8, 16
#: Partitions of work that Spark would deal out by bytes, at most.
TASKS = 4096
POSITIVES, NEGATIVES = 5, 10
_OPEN = np.int64(1) << np.int64(61)
_LAST = np.iinfo(np.int64).max


# ---- vectors --------------------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (long), vector (array of int) of the rows that take part."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null")
    rows = rows.mapInArrow(_quantised, "vec_id long, label long, vector array<int>")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), "vector")


def _quantised(batches):
    for batch in batches:
        vectors = batch.column("vector")
        ends = np.r_[0, np.cumsum(np.asarray(vectors.value_lengths(), np.int64))]
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        fits = np.abs(x) < LARGEST / SCALE
        bad = np.r_[0, np.cumsum(~fits)]
        x = np.floor(np.where(fits, x, 0) * SCALE).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x))
        rows = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), made], ["vec_id", "label", "vector"])
        yield rows.filter(pa.array(bad[ends[1:]] == bad[ends[:-1]]))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column as the rows of a matrix, shorter ones padded."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    values = np.asarray(column.flatten(), np.int64)
    if not len(lengths):
        return np.zeros((0, 0), np.int64)
    if lengths.min() == lengths.max():
        return values.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), lengths.max()), np.int64)
    out[np.arange(lengths.max()) < lengths[:, None]] = values
    return out


def _packed(x: np.ndarray) -> bytes:
    """Rows as bytes: the least component, then the lowest bytes of all components above it, the next ones, and so on."""
    if not x.size:
        return b""
    least = x.min()
    planes = np.ascontiguousarray((x - least).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.int64(least).tobytes() + planes[: max(1, 1 + max(np.flatnonzero(planes.any(1)), default=0))].tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    if not rows * width:
        return np.zeros((rows, width), np.int64)
    out = np.full(rows * width, np.frombuffer(data, np.int64, 1)[0])
    for i, plane in enumerate(np.frombuffer(data, np.uint8, offset=8).reshape(-1, rows * width)):
        out += plane.astype(np.int64) << (8 * i)
    return out.reshape(rows, width)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in the narrowest arithmetic that cannot round."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * width
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a @ b.T


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = _norms(a)[:, None] + _norms(b)[None, :] - 2 * dots(a, b)
    return np.sqrt(squared.astype(np.float64))


def _ranked(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each owner, by score downwards and id upwards."""
    span = int(score.max()) - int(score.min()) + 1 if len(score) else 1
    if len(owner) and (int(owner.max()) + 1) * span < 1 << 62:
        # One number for owner and score; ids only where it is equal.
        key = owner * span + (score.max() - score)
        order = np.argsort(key)
        key = key[order]
        equal = key[1:] == key[:-1]
        tied = np.flatnonzero(np.r_[equal, False] | np.r_[False, equal])
        order[tied] = order[tied][np.lexsort((ids[order[tied]], key[tied]))]
    else:
        order = np.lexsort((ids, -score, owner))
    mine = owner[order]
    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, np.int64)
    place = np.arange(len(mine)) - np.repeat(first, np.diff(np.r_[first, len(mine)]))
    return order[place < k]


# ---- nodes ----------------------------------------------------------------------------------------------


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """Places of up to k rows that are far from each other and not equal."""
    chosen = [0] if len(x) else []
    near = _distances(x, x[:1])[:, 0] if len(x) else None
    while 0 < len(chosen) < k and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return np.array(chosen, np.int64)


@dataclass
class Ranges:
    """Distances from split point i to the rows of subtree j, norms of these rows, and their number."""

    low: np.ndarray
    high: np.ndarray
    norm_low: np.ndarray
    norm_high: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, k: int) -> Ranges:
        return cls(np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k, np.int64))

    def add(self, distances: np.ndarray, nearest: np.ndarray, norms: np.ndarray) -> None:
        for j in np.unique(nearest):
            own = nearest == j
            self.low[:, j] = np.minimum(self.low[:, j], distances[own].min(0))
            self.high[:, j] = np.maximum(self.high[:, j], distances[own].max(0))
            self.norm_low[j] = min(self.norm_low[j], norms[own].min())
            self.norm_high[j] = max(self.norm_high[j], norms[own].max())
            self.rows[j] += own.sum()

    def meets(self, to_points: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether subtree j may hold a row in one of the score windows of query q: a matrix (q, j).

        `low` and `high` are (q, windows); an empty window has low above high.
        """
        out = np.zeros((len(norms), len(self.rows)), bool)
        norms = norms.astype(np.float64)[:, None]
        for w in range(low.shape[1]):
            far = norms + self.norm_high - 2.0 * low[:, w, None]
            near = norms + self.norm_low - 2.0 * high[:, w, None]
            live = (low[:, w, None] <= high[:, w, None]) & (far >= -1e-6) & (self.rows > 0)
            far, near = np.sqrt(np.maximum(far, 0)), np.sqrt(np.maximum(near, 0))
            for i in range(len(self.rows)):
                at, slack = to_points[:, i, None], 1e-6 * (1 + to_points[:, i, None])
                live &= (self.low[i] <= at + far + slack) & (self.high[i] >= np.maximum(at - far, near - at) - slack)
            out |= live
        return out


@dataclass
class Tree:
    """Upper levels: split points of each node; below each point another node, or the cell -1 - number."""

    points: list[np.ndarray] = field(default_factory=list)
    below: list[np.ndarray] = field(default_factory=list)
    cells: int = 0

    @classmethod
    def grown(cls, x: np.ndarray, rows: int) -> Tree:
        tree = cls()

        def add(own: np.ndarray) -> int:
            number = len(tree.points)
            at = own[spread(own, FANOUT)]
            tree.points.append(at)
            tree.below.append(np.zeros(len(at), np.int64))
            nearest = _distances(own, at).argmin(1)
            for j in range(len(at)):
                part = own[nearest == j]
                if rows * len(part) > CELL * len(x) and len(np.unique(part, axis=0)) >= 4 * FANOUT:
                    tree.below[number][j] = add(part)
                else:
                    tree.below[number][j] = -1 - tree.cells
                    tree.cells += 1
            return number

        add(x)
        return tree

    def routed(self, x: np.ndarray, ranges: list[Ranges] | None = None) -> np.ndarray:
        """Cell of each row; `ranges`, one of each node, take the rows in."""
        cell, norms = np.zeros(len(x), np.int64), _norms(x)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            distances = _distances(x[rows], self.points[node])
            nearest = distances.argmin(1)
            if ranges is not None:
                ranges[node].add(distances, nearest, norms[rows])
            for j in np.unique(nearest):
                own, next_ = rows[nearest == j], self.below[node][j]
                if next_ < 0:
                    cell[own] = -1 - next_
                else:
                    waiting.append((int(next_), own))
        return cell

    def reached(self, ranges: list[Ranges], x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether query q may find rows in a cell: a matrix (q, cell)."""
        out = np.zeros((len(x), self.cells), bool)
        norms = _norms(x)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            meets = ranges[node].meets(_distances(x[rows], self.points[node]), norms[rows], low[rows], high[rows])
            for j, next_ in enumerate(self.below[node]):
                own = rows[meets[:, j]]
                if next_ < 0:
                    out[own, -1 - next_] = True
                elif len(own):
                    waiting.append((int(next_), own))
        return out


# ---- index ----------------------------------------------------------------------------------------------


@dataclass
class Index:
    """The upper tree with its ranges, number of blocks of each cell, the sample, the table of blocks, and their layout."""

    tree: Tree
    ranges: list[Ranges]
    blocks: np.ndarray
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]
    table: DataFrame
    turn: np.ndarray
    panel: np.ndarray


_RANGES = "node int, i int, j int, low double, high double, norm_low double, norm_high double, n long"
_BLOCK = "block long, turn int, panel int, n int, width int, ids binary, labels binary, vectors binary, points binary, ends binary, low binary, high binary, norms binary"


def _measured(tree: Tree):
    def run(batches):
        ranges = [Ranges.empty(len(p)) for p in tree.points]
        for batch in batches:
            tree.routed(_matrix(batch.column("vector")), ranges)
        for node, r in enumerate(ranges):
            i, j = np.nonzero(np.isfinite(r.low))
            if len(i):
                columns = [np.full(len(i), node, np.int32), i.astype(np.int32), j.astype(np.int32)]
                columns += [r.low[i, j], r.high[i, j], r.norm_low[j], r.norm_high[j], r.rows[j]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["node", "i", "j", "low", "high", "norm_low", "norm_high", "n"]
                )

    return run


def _dealt(tree: Tree, blocks: np.ndarray):
    base = np.r_[0, np.cumsum(blocks)]

    def run(batches):
        at = 7919 * TaskContext.get().partitionId()
        for batch in batches:
            cell = tree.routed(_matrix(batch.column("vector")))
            turn = (at + np.arange(len(cell))) % blocks[cell]
            at += len(cell)
            yield pa.RecordBatch.from_arrays(
                [pa.array(base[cell] + turn), *batch.columns], ["block", "vec_id", "label", "vector"]
            )

    return run


def _layout(blocks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Turn (0, or 1 for those that wait for the bounds of the first) and panel of each block."""
    number = int(blocks.sum())
    of_cell = np.arange(number) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    turn = (of_cell % FIRST != 0) if number > PANELS else np.zeros(number, bool)
    most = max(1, min(PANEL, PANEL_SIZE // max(width, 1)) // BLOCK)
    place = np.where(turn, np.cumsum(turn), np.cumsum(~turn)) - 1
    return turn.astype(np.int64), place // np.where(turn | (number <= PANELS), min(most, max(1, number // PANELS)), most)


def _built(turn: np.ndarray, panel: np.ndarray):
    """One block: rows ordered by leaf, the node's points and ranges."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table.column("vector").combine_chunks())
        ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        at = spread(x, FANOUT)
        distances = _distances(x, x[at])
        leaf = distances.argmin(1)
        ranges = Ranges.empty(len(at))
        ranges.add(distances, leaf, _norms(x))
        order = np.lexsort((ids, leaf))
        block = table.column("block")[0].as_py()
        row = {
            "block": block,
            "turn": int(turn[block]),
            "panel": int(panel[block]),
            "n": len(ids),
            "width": x.shape[1],
            "ids": ids[order].tobytes(),
            "labels": labels[order].tobytes(),
            "vectors": _packed(x[order]),
            "points": _packed(x[at]),
            "ends": np.cumsum(np.bincount(leaf, minlength=len(at))).tobytes(),
            "low": ranges.low.tobytes(),
            "high": ranges.high.tobytes(),
            "norms": np.r_[ranges.norm_low, ranges.norm_high].tobytes(),
        }
        kinds = {"block": pa.int64()} | dict.fromkeys(("turn", "panel", "n", "width"), pa.int32())
        return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})

    return run


def index(rows: DataFrame) -> Index | None:
    """The tree over all rows of `usable`; None for an empty table."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "vector").limit(SAMPLE).toArrow().combine_chunks()
    if not sample.num_rows:
        return None
    x = _matrix(sample.column("vector").combine_chunks())
    tree = Tree.grown(x, rows.count())
    ranges = [Ranges.empty(len(p)) for p in tree.points]
    least = rows.mapInArrow(_measured(tree), _RANGES).groupBy("node", "i", "j")
    least = least.agg(
        *[F.min(c).alias(c) for c in ("low", "norm_low")], *[F.max(c).alias(c) for c in ("high", "norm_high")], F.sum("n").alias("n")
    )
    # One row for each pair of siblings of the upper tree, which the sample bounds.
    for r in least.collect():
        to, i, j = ranges[r["node"]], r["i"], r["j"]
        to.low[i, j], to.high[i, j] = r["low"], r["high"]
        to.norm_low[j], to.norm_high[j], to.rows[j] = r["norm_low"], r["norm_high"], r["n"]
    counts = np.zeros(tree.cells, np.int64)
    for r, below in zip(ranges, tree.below):
        counts[-1 - below[below < 0]] = r.rows[below < 0]
    blocks = np.maximum(-(-counts // BLOCK), 1)
    placed = rows.mapInArrow(_dealt(tree, blocks), "block long, vec_id long, label long, vector array<int>")
    turn, panel = _layout(blocks, x.shape[1])
    table = staged(placed.groupBy("block").applyInArrow(_built(turn, panel), _BLOCK), "vector-blocks")
    labels, ids = (sample.column(c).to_numpy().astype(np.int64) for c in ("label", "vec_id"))
    return Index(tree, ranges, blocks, (x, ids, labels), table, turn, panel)


# ---- search ---------------------------------------------------------------------------------------------

_CHUNK = "chunk long, n int, width int, ids binary, labels binary, vectors binary, scores binary, low binary, high binary"


def _chunk_row(chunk: int, ids, labels, x, scores, low, high) -> pa.Table:
    row = {
        "chunk": pa.array([chunk], pa.int64()),
        "n": pa.array([len(ids)], pa.int32()),
        "width": pa.array([x.shape[1]], pa.int32()),
    }
    data = {"ids": ids, "labels": labels, "scores": scores, "low": low, "high": high}
    data = {k: np.ascontiguousarray(v).tobytes() for k, v in data.items()} | {"vectors": _packed(x)}
    return pa.table(row | {k: pa.array([data[k]], pa.binary()) for k in ("ids", "labels", "vectors", "scores", "low", "high")})


def _read(row: dict, *names: str) -> list[np.ndarray]:
    """Arrays of a chunk or block; those of windows have a column for each."""
    out = []
    for name in names:
        if name in ("vectors", "points"):
            out.append(_unpacked(row[name], row["n"] if name == "vectors" else len(row["ends"]) // 8, row["width"]))
        elif name in ("low", "high", "scores"):
            out.append(np.frombuffer(row[name], np.int64).reshape(row["n"], -1))
        else:
            out.append(np.frombuffer(row[name], np.int64))
    return out


def _bounded(anchors, sample, low, high, same: bool, k: int) -> np.ndarray:
    """Lower ends of the windows, raised to the k-th best row of the sample where it has that many."""
    x, ids, labels = anchors
    raised = low.copy()
    if len(sample[1]) >= k:
        scores = dots(x, sample[0])
        scores[((labels[:, None] == sample[2]) != same) | (ids[:, None] == sample[1])] = -_OPEN
        for w in range(low.shape[1]):
            inside = np.where(scores <= high[:, w, None], scores, -_OPEN)
            raised[:, w] = np.maximum(low[:, w], np.partition(inside, -k, axis=1)[:, -k])
    return raised


def _chunked(sample):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table.column("vector").combine_chunks())
        ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        low, high = np.full((len(ids), 1), -_OPEN), np.full((len(ids), 1), _OPEN)
        low = _bounded((x, ids, labels), sample, low, high, True, POSITIVES)
        return _chunk_row(table.column("chunk")[0].as_py(), ids, labels, x, np.zeros((len(ids), 1), np.int64), low, high)

    return run


def _windowed(sample):
    """Chunks whose windows are those of the positives: from 30 to 90 hundredths of each one's score."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        ids, labels, x = _read(row, "ids", "labels", "vectors")
        scores = np.zeros((len(ids), POSITIVES), np.int64)
        low, high = np.full(scores.shape, 1), np.zeros(scores.shape, np.int64)
        anchor, place, score = (found.column(c).to_numpy().astype(np.int64) for c in ("anchor", "place", "score"))
        scores[anchor, place - 1] = score
        low[anchor, place - 1], high[anchor, place - 1] = -(-3 * score // 10), 9 * score // 10
        low = _bounded((x, ids, labels), sample, low, high, False, NEGATIVES)
        return _chunk_row(row["chunk"], ids, labels, x, scores, low, high)

    return run


def _raised(k: int):
    """Chunks whose windows begin at the row that ends a full list of `found`."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        ids, labels, x, scores, low, high = _read(row, "ids", "labels", "vectors", "scores", "low", "high")
        low = low.copy()
        for hits in found.to_pylist():
            owner, _, score = _hits(hits)
            ends = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(0, np.int64)
            ends = ends[np.diff(np.r_[-1, ends]) >= k]
            low.ravel()[owner[ends]] = np.maximum(low.ravel()[owner[ends]], score[ends])
        return _chunk_row(row["chunk"], ids, labels, x, scores, low, high)

    return run


def _directed(made: Index, turn: int, count: int, same: bool):
    """Chunks, once for each panel that one of their anchors may find rows in, with the cells that each may."""
    own = np.flatnonzero(made.turn == turn)
    cell = np.repeat(np.arange(len(made.blocks)), made.blocks)[own]
    starts = np.flatnonzero(np.diff(made.panel[own], prepend=-1))
    tree, ranges, first, last = made.tree, made.ranges, cell[starts], cell[np.r_[starts[1:], len(own)] - 1]
    groups = _groups(made, count, len(first), same)

    def run(batches):
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                x, low, high = _read(row, "vectors", "low", "high")
                reached = tree.reached(ranges, x, low, high)
                cells = np.r_[0, np.cumsum(reached.any(0))]
                wanted = np.flatnonzero(cells[last + 1] > cells[first])
                for i in range(0, len(wanted), 16):
                    part = wanted[i : i + 16]
                    bits = [np.packbits(reached[:, first[p] : last[p] + 1]).tobytes() for p in part]
                    task = part * groups + row["number"] % groups
                    columns = [pa.repeat(c[at], len(part)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(task.astype(np.int32)), pa.array(bits, pa.binary()), *columns], ["task", "reached", *batch.schema.names]
                    )

    return run, groups, first, last


def _groups(made: Index, count: int, panels: int, same: bool) -> int:
    """Groups of `count` chunks that meet so many panels; lists of positives are an eighth of the others' size."""
    most = min(GROUP, GROUP_SIZE // max(made.sample[0].shape[1], 1)) * (2 if same else 1) // CHUNK
    return max(-(-count // max(1, most)), min(count, GROUPS, -(-PANELS // panels)))


def _kind(a: np.ndarray, b: np.ndarray):
    """The narrowest arithmetic that cannot round products of rows with these norms."""
    most = np.sqrt(float(a.max(initial=0))) * np.sqrt(float(b.max(initial=0))) * (1 + 1e-9) + 1
    return (np.float32, 1 << 24) if most < 1 << 24 else (np.float64, 1 << 53) if most < 1 << 53 else (np.int64, _LAST)


class _Group:
    """Anchors of one task and the first k rows of each of their windows, of the rows that have passed."""

    def __init__(self, rows: list[dict], cells: int, same: bool, k: int):
        read = [_read(r, "ids", "labels", "vectors", "low", "high") for r in rows]
        sizes = [len(r[0]) for r in read]
        order = np.argsort(np.concatenate([r[1] for r in read]), kind="stable")
        self.ids, self.labels, self.low, self.high = (np.concatenate([r[c] for r in read])[order] for c in (0, 1, 3, 4))
        self.x = np.zeros((len(order), max(r[2].shape[1] for r in read)), np.int64)
        for r, start in zip(read, np.cumsum(sizes) - sizes):
            self.x[start : start + len(r[0]), : r[2].shape[1]] = r[2]
        self.x, self.same, self.k = self.x[order], same, k
        bits = [np.unpackbits(np.frombuffer(r["reached"], np.uint8), count=n * cells).reshape(n, cells) for r, n in zip(rows, sizes)]
        self.reached = np.concatenate(bits).astype(bool)[order]
        self.chunk, self.anchor = np.repeat([r["number"] for r in rows], sizes)[order], np.concatenate([np.arange(n) for n in sizes])[order]
        self.norms, self.as_kind = _norms(self.x), {}
        self.last = np.full(self.low.shape, _LAST)
        self.lists, self.new, self.n_new = [np.zeros(0, np.int64)] * 3, [], 0
        self._bound()

    def _bound(self) -> None:
        """One window around those of an anchor that are not empty."""
        live = self.low <= self.high
        self.least, self.most = np.where(live, self.low, _OPEN).min(1), np.where(live, self.high, -_OPEN).max(1)

    def add(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        places, low = self.low.shape[1], self.low[anchor]
        at = np.flatnonzero((score[:, None] >= low) & (score[:, None] <= self.high[anchor]))
        own = at // places
        owner = anchor[own] * places + at % places
        fits = (score[own] > low.ravel()[at]) | (ids[own] <= self.last.ravel()[owner])
        if fits.any():
            self.new.append((owner[fits], ids[own[fits]], score[own[fits]]))
            self.n_new += len(self.new[-1][0])
        if self.n_new > max(1 << 18, len(self.lists[0]) // 2):
            self.settle()

    def settle(self) -> None:
        """Lists take in what is new, and windows begin where full lists end."""
        owner, ids, score = (np.concatenate(c) for c in zip(self.lists, *self.new))
        first = _ranked(owner, score, ids, self.k)
        self.lists, self.new, self.n_new = [owner[first], ids[first], score[first]], [], 0
        owner, ids, score = self.lists
        ends = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(0, np.int64)
        ends = ends[np.diff(np.r_[-1, ends]) >= self.k]
        own, low = owner[ends], self.low.ravel()
        ends = ends[score[ends] >= low[own]]
        own = owner[ends]
        low[own], self.last.ravel()[own] = score[ends], ids[ends]
        self._bound()

    def meet(self, block: dict, cell: int) -> None:
        """Rows of a block, of which `cell` is the place of its cell in the panel."""
        own = np.flatnonzero(self.reached[:, cell] & (self.least <= self.most))
        if not len(own):
            return
        ids, labels, x, ends = _read(block, "ids", "labels", "vectors", "ends")
        kind, limit = _kind(self.norms[own], _norms(x))
        width = min(x.shape[1], self.x.shape[1])
        if kind not in self.as_kind:
            self.as_kind[kind] = self.x.astype(kind)
        left, right = self.as_kind[kind][:, :width], x[:, :width].astype(kind)
        least, most = (np.clip(b, -limit, limit).astype(kind) for b in (self.least, self.most))
        out = np.empty(TILE[0] * TILE[1], kind)
        for anchors, rows in self._parts(block, own, labels, ends, width):
            parts = [rows[i : i + TILE[1]] for i in range(0, len(rows), TILE[1])]
            parts = [(part, right[part].T) for part in parts]
            for start in range(0, len(anchors), TILE[0]):
                some = anchors[start : start + TILE[0]]
                z, low, high = left[some], least[some], most[some]
                for part, y in parts:
                    scores = np.matmul(z, y, out=out[: len(some) * len(part)].reshape(len(some), -1))
                    hit = np.flatnonzero(scores.max(1) >= low)
                    if not len(hit):
                        continue
                    scores = scores[hit]
                    at = np.flatnonzero((scores >= low[hit, None]) & (scores <= high[hit, None]))
                    a, r = some[hit[at // len(part)]], part[at % len(part)]
                    keep = self.ids[a] != ids[r]
                    if not self.same:
                        keep &= self.labels[a] != labels[r]
                    if keep.any():
                        self.add(a[keep], ids[r[keep]], scores.ravel()[at[keep]].astype(np.int64))

    def _parts(self, block: dict, own: np.ndarray, labels: np.ndarray, ends: np.ndarray, width: int):
        """(anchors, rows) that have to meet."""
        every = np.arange(len(labels))
        if self.same:
            order = np.argsort(labels, kind="stable")
            starts = np.flatnonzero(np.r_[True, labels[order][1:] != labels[order][:-1]])
            of = self.labels[own]
            pairs = []
            for rows in np.split(order, starts[1:]):
                low, high = np.searchsorted(of, labels[rows[0]], "left"), np.searchsorted(of, labels[rows[0]], "right")
                if low < high:
                    pairs.append((own[low:high], rows))
        else:
            pairs = [(own, every)]
        leaves = len(ends)
        for anchors, rows in pairs:
            saved, cost = len(rows) * width, 200 * leaves * leaves
            if leaves > 1 and saved > cost:
                sizes = np.bincount(np.searchsorted(ends, rows, "right"), minlength=leaves)
                few = self._meets(block, anchors[:: max(1, len(anchors) // 32)])
                if (~few @ sizes).mean() * width > cost:
                    meets, leaf = self._meets(block, anchors), np.searchsorted(ends, rows, "right")
                    for j in np.flatnonzero(sizes):
                        some = anchors[meets[:, j]]
                        if len(some):
                            yield some, rows[leaf == j]
                    continue
            yield anchors, rows

    def _meets(self, block: dict, anchors: np.ndarray) -> np.ndarray:
        points, ends = _read(block, "points", "ends")
        low, high, norms = (np.frombuffer(block[c], np.float64) for c in ("low", "high", "norms"))
        n = len(ends)
        ranges = Ranges(low.reshape(n, -1), high.reshape(n, -1), *norms.reshape(2, -1), np.diff(np.r_[0, ends]))
        return ranges.meets(_distances(self.x[anchors], points), self.norms[anchors], self.least[anchors, None], self.most[anchors, None])

    def found(self) -> pa.RecordBatch | None:
        """The lists, one row for each chunk."""
        self.settle()
        owner, ids, score = self.lists
        if not len(owner):
            return None
        places = self.low.shape[1]
        anchor = owner // places
        order = np.argsort(self.chunk[anchor], kind="stable")
        chunk = self.chunk[anchor[order]]
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        owner = (self.anchor[anchor] * places + owner % places)[order]
        parts = [[p.tobytes() for p in np.split(c, starts[1:])] for c in (owner.astype(np.int32), ids[order], score[order])]
        return pa.RecordBatch.from_arrays([pa.array(chunk[starts], pa.int64()), *[pa.array(p, pa.binary()) for p in parts]], ["chunk", "owners", "ids", "scores"])


_HITS = "chunk long, owners binary, ids binary, scores binary"


def _hits(row: dict) -> list[np.ndarray]:
    return [np.frombuffer(row[c], t).astype(np.int64) for c, t in (("owners", np.int32), ("ids", np.int64), ("scores", np.int64))]


def _searched(same: bool, k: int, groups: int, base: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Exact search: of each task, the chunks come first, then the blocks of its panel one by one."""

    def run(batches):
        task, chunks, group = None, [], None
        for batch in batches:
            for at in range(batch.num_rows):
                now, kind = batch.column("task")[at].as_py(), batch.column("kind")[at].as_py()
                if now != task:
                    if group is not None and (found := group.found()) is not None:
                        yield found
                    task, chunks, group = now, [], None
                if kind and not chunks:
                    continue
                row = {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                if not kind:
                    chunks.append(row)
                    continue
                panel = task // groups
                if group is None:
                    group = _Group(chunks, int(last[panel] - first[panel]) + 1, same, k)
                group.meet(row, int(np.searchsorted(base, row["number"], "right") - 1 - first[panel]))
        if group is not None and (found := group.found()) is not None:
            yield found

    return run


def _merged(k: int):
    """One row of a chunk for those of all its tasks."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        owner, ids, score = (np.concatenate(c) for c in zip(*map(_hits, rows)))
        first = _ranked(owner, score, ids, k)
        data = {"owners": owner[first].astype(np.int32), "ids": ids[first], "scores": score[first]}
        return pa.table({"chunk": pa.array([rows[0]["chunk"]], pa.int64())} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in data.items()})

    return run


def _listed(places: int):
    """Rows of the lists, which are in order."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                owner, ids, score = _hits(row)
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)])) + 1
                columns = [np.full(len(owner), row["chunk"]), owner // places, owner % places, ids, score, rank.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chunk", "anchor", "place", "vec_id", "score", "rank"])

    return run


def _search(chunks: DataFrame, made: Index, same: bool, k: int, places: int, count: int) -> DataFrame:
    """chunk, anchor, place, vec_id, score, rank: the first k rows of every window, of `places` windows an anchor."""
    base = np.cumsum(made.blocks) - made.blocks
    lists = None
    for turn in range(int(made.turn.max()) + 1):
        directed, groups, first, last = _directed(made, turn, count, same)
        asked = chunks.drop("scores").withColumnRenamed("chunk", "number")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        asked = asked.mapInArrow(directed, f"task int, reached binary, {kinds}").withColumn("kind", F.lit(0))
        group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        blocks = made.table.where(F.col("turn") == turn).withColumn("group", group).withColumn("kind", F.lit(1))
        blocks = blocks.withColumn("task", F.col("panel") * groups + F.col("group")).withColumnRenamed("block", "number")
        tasks = len(first) * groups
        both = asked.unionByName(blocks.drop("turn", "panel", "group"), allowMissingColumns=True)
        # A task is a partition: its work goes with anchors times rows, so a hash would not deal it out evenly.
        both = both.repartitionById(min(tasks, TASKS), F.col("task") % min(tasks, TASKS)).sortWithinPartitions("task", "kind")
        found = both.mapInArrow(_searched(same, k, groups, base, first, last), _HITS)
        found = found if lists is None else found.unionByName(lists)
        lists = found.groupBy("chunk").applyInArrow(_merged(k), _HITS)
        if turn < made.turn.max():
            lists = staged(lists, "lists")
            chunks = staged(chunks.repartition(min(count, TASKS), "chunk").groupBy("chunk").cogroup(lists.groupBy("chunk")).applyInArrow(_raised(k), _CHUNK), "raised")
    return lists.mapInArrow(_listed(places), "chunk long, anchor long, place long, vec_id long, score long, rank int")


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from `vectors(vec_id, embedding, label)`."""
    rows = staged(usable(vectors), "vectors")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    made = index(rows)
    anchors = rows.where("vec_id % 100 = 0").distinct()
    count = anchors.count() if made else 0
    if not count:
        released(rows)
        return vectors.sparkSession.createDataFrame([], empty)
    count = -(-count // CHUNK)
    chunk = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(count))
    chunks = anchors.withColumn("chunk", chunk).repartition(min(count, TASKS), "chunk").groupBy("chunk").applyInArrow(_chunked(made.sample), _CHUNK)
    chunks = staged(chunks, "anchors")
    released(rows)
    positives = _search(chunks, made, True, POSITIVES, 1, count).drop("place").withColumnRenamed("rank", "place")
    positives = staged(positives, "positives")
    windows = chunks.repartition(min(count, TASKS), "chunk").groupBy("chunk").cogroup(positives.groupBy("chunk")).applyInArrow(_windowed(made.sample), _CHUNK)
    negatives = _search(staged(windows, "windows"), made, False, NEGATIVES, POSITIVES, count)
    named = chunks.mapInArrow(_names, "chunk long, anchor long, anchor_id long")
    pairs = positives.select(
        "chunk", "anchor", (F.col("place") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    negatives = negatives.select("chunk", "anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(named, ["chunk", "anchor"]).join(negatives, ["chunk", "anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _names(batches):
    for batch in batches:
        for row in batch.select(["chunk", "ids"]).to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), row["chunk"])), pa.array(np.arange(len(ids))), pa.array(ids)], ["chunk", "anchor", "anchor_id"]
            )
