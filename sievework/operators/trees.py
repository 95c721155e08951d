"""Decision trees and forests grown to the end, in two phases.

1. A node of more than ``finish_rows`` rows is split from histograms. Each level is one scan that
   sends every row down the trees so far and counts it per (node, feature, bin); of two open
   children the smaller one is counted and the larger one is its parent minus the smaller. The best
   cut of a node comes from running sums over its bins; only the chosen splits reach the driver.
   Cuts are quantiles of the whole column, or of the node where those no longer part its rows.
2. The rows of a smaller node go to one task by node, which grows that part to its end exactly: all
   cuts between distinct values, level by level for all nodes at once, on presorted columns.

A forest of a training set of at most ``shared_bytes`` skips the shuffle of rows times trees: each
task is handed the set and grows whole trees.

A tree's top is held by the driver (one node per ``finish_rows`` rows); the parts below are a table
(tree, node, blob). Rows are scored by tasks that hold all parts if these are small, else a row goes
to its part in every tree by key, crowded parts being cut into chunks.

Rows times trees may be many times the input, and so may a grown-out forest. Rows are sent to parts, and
scored, for so many trees at once as ``ROUND_BYTES`` allow; what a round wrote is removed after it. A
forest of more than one round keeps its training rows instead of its parts: the parts of a round are
grown, score all rows and are gone. ``save`` writes them.

Classes are split by the Gini index, numbers by variance. A node ends when its labels are equal or its
rows can not be told apart; rows of equal features share a leaf. Equal gains go to the first feature
and the smallest cut. Bootstrap weights are Poisson draws from a hash of the row's key, so they repeat
on retry. A row without features goes to the root's leaf; rows without a label are not trained on.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import cut_lineage, remove_folder, scratch_folder, shuffles_dropped

#: Open nodes counted in one scan: bounds the histogram that a task holds.
NODES_PER_SCAN = 2048
#: Parts of a model of at most so many bytes are handed to every scoring task.
MODEL_BYTES = 64_000_000
CHUNK_ROWS = 200_000
#: Rows counted or sent on together.
BATCH_ROWS = 200_000
#: Rows whose scores by all trees are summed in one task.
BLOCK_ROWS = 20_000
#: Bytes on disk, before compression, of the trees that are grown or scored together; at least one tree is.
ROUND_BYTES = 4_000_000_000
#: Bytes of the rows in one packed batch.
PACK_BYTES = 32_000_000


@dataclass(frozen=True)
class TreeSpec:
    """``features``: candidates per node, None for all; ``classes``: None for numbers;
    ``finish_rows``: None is a 64th of the rows, between 100,000 and a million."""

    trees: int = 1
    classes: int | None = None
    features: int | None = None
    bootstrap: bool = False
    max_depth: int | None = None
    seed: int = 42
    bins: int = 256
    finish_rows: int | None = None
    shared_bytes: int = 128_000_000


# --- growing one part ---------------------------------------------------------------------


@dataclass
class Part:
    """Nodes in breadth-first order: feature (-1: leaf), cut, left child (right is the next one), value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray  # nodes x outputs; only leaves have one
    gain: np.ndarray  # per feature

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.flatnonzero(self.feature[at] >= 0)
        while len(rows):
            node = at[rows]
            at[rows] = self.left[node] + (x[rows, self.feature[node]] > self.cut[node])
            rows = rows[self.feature[at[rows]] >= 0]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]

    def blob(self) -> bytes:
        """Only leaves keep a value; one output needs no second array beside the cuts."""
        out = io.BytesIO()
        leaf = self.feature < 0
        cut, left = self.cut.copy(), self.left.astype(np.int32)
        if self.value.shape[1] == 1:
            cut[leaf] = self.value[leaf, 0]
            values = np.zeros((0, 1))
        else:
            left[leaf] = np.arange(leaf.sum())
            values = self.value[leaf]
        np.savez(out, feature=self.feature.astype(np.int16), cut=cut, left=left, values=values, gain=self.gain)
        return out.getvalue()

    @staticmethod
    def read(blob: bytes) -> Part:
        z = np.load(io.BytesIO(blob))
        feature, cut, left, values = z["feature"], z["cut"], z["left"].astype(np.int64), z["values"]
        leaf = feature < 0
        value = np.zeros((len(feature), values.shape[1]))
        value[leaf] = cut[leaf][:, None] if values.shape[1] == 1 else values[left[leaf]]
        return Part(feature, cut, left, value, z["gain"])


def _outputs(y: np.ndarray, w: np.ndarray, starts: np.ndarray, classes: int | None) -> np.ndarray:
    """Mean label, or share of every class, of each segment."""
    total = np.add.reduceat(w, starts)
    if classes is None:
        return (np.add.reduceat(w * y, starts) / total)[:, None]
    return np.stack([np.add.reduceat(w * (y == k), starts) for k in range(classes)], axis=1) / total[:, None]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, spec: TreeSpec, seed: list[int], depth: int | None) -> Part:
    """The whole tree of these rows. ``y``: labels, or classes from 0; ``w``: positive weights."""
    n, d = x.shape
    features, cuts, lefts, values = [], [], [], []
    gains = np.zeros(d)
    rng = np.random.default_rng(seed)
    columns = [np.ascontiguousarray(x[:, j]) for j in range(d)]
    order = [np.argsort(c, kind="stable").astype(np.int32) for c in columns] or [np.arange(n, dtype=np.int32)]
    starts, sizes = np.array([0]), np.array([n])
    made = 1
    level = 0
    while len(starts):
        rows = order[0]
        own_y, own_w = y[rows], w[rows]
        value = _outputs(own_y, own_w, starts, spec.classes)
        values.append(value)
        mixed = np.minimum.reduceat(own_y, starts) != np.maximum.reduceat(own_y, starts)
        if d == 0 or (depth is not None and level >= depth):
            mixed[:] = False
        # Nodes of one kind of label end here; only the others are looked at.
        count = len(starts)
        best, best_gain = np.full(count, -1), np.full(count, -np.inf)
        best_cut = np.zeros(count)
        live = np.flatnonzero(mixed)
        if len(live):
            keep = np.repeat(mixed, sizes)
            order = [o[keep] for o in order]
            sizes = sizes[live]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            _best_splits(columns, y, w, order, starts, sizes, value[live], spec, rng, live, best, best_gain, best_cut)
        split = best >= 0
        for j in range(d):
            gains[j] += best_gain[split & (best == j)].sum()
        left = np.zeros(count, dtype=np.int64)
        left[split] = made + 2 * np.arange(split.sum())
        made += 2 * int(split.sum())
        features.append(np.where(split, best, -1))
        cuts.append(best_cut)
        lefts.append(left)
        if not split.any():
            break
        order, starts, sizes = _divide(columns, order, starts, sizes, split[live], best[live], best_cut[live])
        level += 1
    return Part(np.concatenate(features), np.concatenate(cuts), np.concatenate(lefts), np.concatenate(values), gains)


def _best_splits(columns, y, w, order, starts, sizes, value, spec, rng, live, best, best_gain, best_cut) -> None:
    """Sets feature, gain and cut of the nodes ``live``, whose rows are the segments of ``order``."""
    d, m = len(columns), len(live)
    node = np.repeat(np.arange(m, dtype=np.int32), sizes)
    found = np.full((d, m), -np.inf)
    cut = np.zeros((d, m))
    rows = order[0]
    weight = np.add.reduceat(w[rows], starts)
    # Labels less the mean of their node, or a column for every class: both sides' sums follow from one.
    if spec.classes is None:
        own = np.zeros(len(y))
        own[rows] = w[rows] * (y[rows] - value[node, 0])
        parts = [own]
    else:
        parts = [w * (y == k) for k in range(spec.classes)]
    for j in range(d):
        o = order[j]
        xs = columns[j][o]
        at = np.flatnonzero((xs[:-1] < xs[1:]) & (node[:-1] == node[1:]))
        if len(at) == 0:
            continue
        own = node[at]
        below = _sums_at(w[o], at, own, starts)
        above = weight[own] - below
        score = np.zeros(len(at))
        for k, part in enumerate(parts):
            sums = _sums_at(part[o], at, own, starts)
            if spec.classes is None:
                score += sums * sums / below + sums * sums / above
            else:
                total = (value[:, k] * weight)[own]
                score += sums * sums / below + (total - sums) ** 2 / above - total * total / weight[own]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        top = np.maximum.reduceat(score, first)
        lens = np.diff(np.append(first, len(at)))
        place = np.where(score == np.repeat(top, lens), np.arange(len(at)), len(at))
        at = at[np.minimum.reduceat(place, first)]
        has = own[first]
        found[j, has] = top
        lo, hi = xs[at], xs[at + 1]
        middle = lo / 2 + hi / 2
        cut[j, has] = np.where((middle >= lo) & (middle < hi), middle, lo)
    if spec.features is not None and spec.features < d:
        # Of the features that part a node, the first few in a random order.
        turn = np.where(np.isfinite(found), rng.random(found.shape), 2.0)
        limit = np.sort(turn, axis=0)[spec.features - 1]
        found[turn > limit] = -np.inf
    j = found.argmax(axis=0)
    nodes = np.arange(len(live))
    ok = np.isfinite(found[j, nodes])
    best[live[ok]] = j[ok]
    best_gain[live[ok]] = found[j, nodes][ok]
    best_cut[live[ok]] = cut[j, nodes][ok]


def _sums_at(v: np.ndarray, at: np.ndarray, node: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums from the start of its node up to each position of ``at``."""
    sums = np.cumsum(v)
    return sums[at] - (sums[starts] - v[starts])[node]


def _divide(columns, order, starts, sizes, split, feature, cut):
    """The same orders with the rows of every split node parted, others left out."""
    node = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    rows = order[0]
    goes = np.zeros(len(columns[0]), dtype=bool)
    by, limit = feature[node], cut[node]
    for j in range(len(columns)):
        own = by == j
        if own.any():
            some = rows[own]
            goes[some] = columns[j][some] <= limit[own]
    lefts = np.add.reduceat(goes[rows].astype(np.int64), starts)
    kept = np.where(split, sizes, 0)
    at = np.concatenate([[0], np.cumsum(kept)[:-1]])
    keep = np.repeat(split, sizes)
    all_kept = bool(keep.all())
    base, shift = at[node], lefts[node] + np.arange(len(rows)) - starts[node]
    out = []
    for o in order:
        left = goes[o]
        sums = np.cumsum(left)
        rank = sums - left - (sums[starts] - left[starts])[node]
        target = base + np.where(left, rank, shift - rank)
        new = np.empty(int(kept.sum()), dtype=o.dtype)
        if all_kept:
            new[target] = o
        else:
            new[target[keep]] = o[keep]
        out.append(new)
    new_sizes = np.stack([lefts[split], sizes[split] - lefts[split]], axis=1).ravel()
    return out, np.concatenate([[0], np.cumsum(new_sizes)[:-1]]), new_sizes


# --- tops ---------------------------------------------------------------------------------

_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def bootstrap_weights(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A Poisson draw of mean 1 for every row and tree."""
    z = hashes.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = (z ^ (z >> np.uint64(31))) / 2.0**64
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


def row_weights(hashes: np.ndarray, tree: int, spec: TreeSpec) -> np.ndarray:
    return bootstrap_weights(hashes, tree, spec.seed) if spec.bootstrap else np.ones(len(hashes))


@dataclass
class Top:
    """The upper nodes of one tree; node numbers are those of the lists, 0 is the root.

    A leaf with a value is final; one without is the root of a part."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[list[float] | None] = field(default_factory=lambda: [None])
    level: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(0)
            self.value.append(None)
            self.level.append(self.level[node] + 1)
        return self.left[node], self.left[node] + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        part = Part(np.array(self.feature), np.array(self.cut), np.array(self.left), np.zeros((0, 1)), np.zeros(0))
        return part.leaves(x)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _arrays(table: pa.Table | pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and h of plain or packed rows."""
    x, y, h = (table.column(c) for c in ("x", "y", "h"))
    if pa.types.is_binary(x.type):
        return _unpacked(x, float).reshape(-1, d), _unpacked(y, float), _unpacked(h, np.int64)
    return _matrix(x, d), y.to_numpy(), h.to_numpy()


def _large_batches(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y and h of BATCH_ROWS rows or a little more."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for start in range(0, batch.num_rows, step := 1 if pa.types.is_binary(batch.column("x").type) else BATCH_ROWS):
            held.append(_arrays(batch.slice(start, step), d))
            if sum(len(y) for _, y, _ in held) >= BATCH_ROWS:
                yield tuple(np.concatenate(v) for v in zip(*held))
                held.clear()
    if held:
        yield tuple(np.concatenate(v) for v in zip(*held))


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (h, x, y) as bytes, a row per batch, so that a scan costs next to nothing: n, d, x, y, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            values = [t.num_rows, len(x) // t.num_rows, x.tobytes(), t.column("y").to_numpy().tobytes(), t.column("h").to_numpy().tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], a) for v, a in zip(values, types)], ["n", "d", "x", "y", "h"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_ROWS or sum(b.nbytes for b in held) >= PACK_BYTES:
                yield packed()
        if held:
            yield packed()

    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return rows.select("h", "x", "y").mapInArrow(run, "n long, d int, x binary, y binary, h binary")


def _quantile_cuts(df: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """Cuts between about equal shares of rows; every distinct value is one where there are few."""
    probs = [i / bins for i in range(bins)]
    got = df.agg(*[F.percentile_approx(F.col("x")[j], probs, 20 * bins).alias(f"q{j}") for j in range(d)]).first()
    return [np.unique(np.array(got[f"q{j}"] or [], dtype=float)) for j in range(d)]


def _split_large(data: DataFrame, rows: DataFrame, n: int, d: int, spec: TreeSpec) -> tuple[list[Top], np.ndarray]:
    """Tops of all trees whose open nodes have at most ``finish_rows`` rows, and the gain per feature."""
    tops = [Top() for _ in range(spec.trees)]
    gains = np.zeros(d)
    if n <= spec.finish_rows:
        return tops, gains
    rng = np.random.default_rng([spec.seed, 1])
    shared = _quantile_cuts(rows, d, spec.bins)
    # A task sends on a cell of each open node: so many tasks as can run, not as many as there are files.
    data = data.coalesce(max(1, 2 * data.sparkSession.sparkContext.defaultParallelism))
    # (tree, node) -> cuts of its own; the others use the shared ones.
    special: dict[tuple[int, int], list[np.ndarray]] = {}
    large = [(t, 0) for t in range(spec.trees)]
    cells: DataFrame | None = None
    larger_of: dict[tuple[int, int], tuple[tuple[int, int], tuple[int, int]]] = {}
    outputs = spec.classes or 1
    sums = [f"s{k}" for k in range(outputs)]
    while large:
        # The larger of two open children is its parent less the smaller one.
        derived = {node: pair for node, pair in larger_of.items() if node in large}
        counted = [node for node in large if node not in derived]
        found = [_histograms(data, tops, counted[i : i + NODES_PER_SCAN], shared, special, d, spec) for i in range(0, len(counted), NODES_PER_SCAN)]
        new = found[0]
        for more in found[1:]:
            new = new.unionByName(more)
        if derived and cells is not None:
            new = cut_lineage(new)
            rows = [(*parent, *node, 1.0) for node, (parent, _) in derived.items()]
            minus = [(*sibling, *node, -1.0) for node, (_, sibling) in derived.items()]
            schema = "tree int, node int, to_tree int, to_node int, sign double"
            spark = data.sparkSession
            parts = []
            for source, moves in ((cells, rows), (new, minus)):
                moved = source.join(spark.createDataFrame(moves, schema), ["tree", "node"])
                parts.append(moved.select(F.col("to_tree").alias("tree"), F.col("to_node").alias("node"), "feature", "bin", *[(F.col(c) * F.col("sign")).alias(c) for c in ("n", "w", *sums)]))
            rest = parts[0].unionByName(parts[1]).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "w", *sums)])
            new = new.unionByName(rest.where("n > 0"))
        cells = cut_lineage(new)
        chosen = _chosen(cells, sums, spec, large, d, rng)
        next_large, larger_of = [], {}
        stuck = []
        for tree, node in large:
            got = chosen.get((tree, node))
            top = tops[tree]
            if got is None or (spec.max_depth is not None and top.level[node] >= spec.max_depth):
                if got is None and (tree, node) not in special and (spec.max_depth is None or top.level[node] < spec.max_depth):
                    stuck.append((tree, node))
                continue
            feature, code, gain, n_left, n_right = got
            gains[feature] += gain
            cut = special.get((tree, node), shared)[feature][code]
            left, right = top.split(node, feature, float(cut))
            open_ = [(child, rows) for child, rows in ((left, n_left), (right, n_right)) if rows > spec.finish_rows]
            next_large += [(tree, child) for child, _ in open_]
            if len(open_) == 2 and (tree, node) not in special:
                small, big = (left, right) if n_left <= n_right else (right, left)
                larger_of[tree, big] = ((tree, node), (tree, small))
        for tree, node in stuck:
            # No shared cut parts these rows: quantiles of the node itself, once.
            own = _routed(data, tops, d, spec, only=(tree, node))
            special[tree, node] = _quantile_cuts(own, d, spec.bins)
        large = next_large + stuck
    return tops, gains


def _histograms(data: DataFrame, tops: list[Top], nodes: list[tuple[int, int]], shared, special, d: int, spec: TreeSpec) -> DataFrame:
    """tree, node, feature, bin, n, w and sums of labels of the rows in ``nodes``."""
    outputs = spec.classes or 1
    by_tree: dict[int, dict[int, int]] = {}
    for i, (tree, node) in enumerate(nodes):
        by_tree.setdefault(tree, {})[node] = i
    width = max([spec.bins + 1] + [len(c) + 1 for s in special.values() for c in s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2 + outputs, len(nodes), d, width))
        # A count costs its whole table, so many rows are counted at once and each tree by itself.
        for x, y, h in _large_batches(batches, d):
            code = [np.searchsorted(shared[j], x[:, j], side="left") for j in range(d)]
            for tree, own in by_tree.items():
                w = row_weights(h, tree, spec)
                leaf = tops[tree].leaves(x)
                number = np.full(len(tops[tree].feature), -1)
                number[list(own)] = np.arange(len(own))
                at = number[leaf]
                rows = np.flatnonzero((at >= 0) & (w > 0))
                at, own_w, own_y = at[rows], w[rows], y[rows]
                own_code = [c[rows] for c in code]
                for i, node in enumerate(own):
                    if (tree, node) in special:
                        inside = np.flatnonzero(at == i)
                        for j in range(d):
                            own_code[j][inside] = np.searchsorted(special[tree, node][j], x[rows[inside], j], side="left")
                place, size = np.array(list(own.values())), len(own) * width
                for j in range(d):
                    cell = at * width + own_code[j]
                    n = np.bincount(cell, minlength=size).astype(float)
                    if spec.classes is None:
                        sums = [np.bincount(cell, weights=own_w * own_y, minlength=size)]
                        weight = np.bincount(cell, weights=own_w, minlength=size) if spec.bootstrap else n
                    else:
                        sums = np.bincount(cell * outputs + own_y.astype(np.int64), weights=own_w, minlength=size * outputs).reshape(size, outputs).T
                        weight = np.sum(sums, axis=0)
                    for k, v in enumerate((n, weight, *sums)):
                        table[k, place, j] += v.reshape(len(own), width)
        table = table.reshape(2 + outputs, -1)
        cell = np.flatnonzero(table[0])
        if len(cell):
            node = cell // (d * width)
            pairs = np.array(nodes, dtype=np.int32)[node]
            columns = [pairs[:, 0], pairs[:, 1], (cell // width % d).astype(np.int32), (cell % width).astype(np.int32), *table[:, cell]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "node", "feature", "bin", *names])

    names = ["n", "w", *[f"s{k}" for k in range(outputs)]]
    ddl = "tree int, node int, feature int, bin int, " + ", ".join(f"{c} double" for c in names)
    parts = data.select("h", "x", "y").mapInArrow(run, ddl)
    return parts.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in names])


def _chosen(cells: DataFrame, sums: list[str], spec: TreeSpec, large: list[tuple[int, int]], d: int, rng) -> dict:
    """(feature, bin, gain, rows left, rows right) of the best cut of every node that has one."""
    place = ["tree", "node", "feature"]
    up = Window.partitionBy(*place).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*place)
    cols: dict[str, Column] = {c: F.sum(c).over(up) for c in ("n", "w", *sums)}
    ran = cells.select(*place, "bin", *[v.alias(f"l_{c}") for c, v in cols.items()], *[F.sum(c).over(whole).alias(f"t_{c}") for c in cols])
    w_left, w_all = F.col("l_w"), F.col("t_w")
    gain = F.lit(0.0)
    for s in sums:
        left, total = F.col(f"l_{s}"), F.col(f"t_{s}")
        gain = gain + left * left / w_left + (total - left) * (total - left) / (w_all - w_left) - total * total / w_all
    ran = ran.where("l_n < t_n").withColumn("gain", gain)
    if spec.features is not None and spec.features < d:
        few = [(t, n, int(j)) for t, n in large for j in rng.permutation(d)[: spec.features]]
        ran = ran.join(cells.sparkSession.createDataFrame(few, "tree int, node int, feature int").withColumn("few", F.lit(1)), place, "left")
    else:
        ran = ran.withColumn("few", F.lit(1))
    # A node whose drawn features are constant takes any other.
    order = F.struct(F.coalesce("few", F.lit(0)), "gain", -F.col("feature"), -F.col("bin"))
    best = ran.groupBy("tree", "node").agg(F.max_by(F.struct("feature", "bin", "gain", F.col("l_n").alias("a"), (F.col("t_n") - F.col("l_n")).alias("b")), order).alias("b"))
    return {(r["tree"], r["node"]): tuple(r["b"]) for r in best.collect()}


def _routed(data: DataFrame, tops: list[Top], d: int, spec: TreeSpec, only: tuple[int, int] | None = None) -> DataFrame:
    """tree, node, x, y, w and hash of every row in each tree that draws it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, h in _large_batches(batches, d):
            for tree in range(spec.trees) if only is None else [only[0]]:
                w = row_weights(h, tree, spec)
                leaf = tops[tree].leaves(x)
                rows = np.flatnonzero((w > 0) & ((leaf == only[1]) if only else True))
                ends = np.arange(len(rows) + 1, dtype=np.int32) * d
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), tree, dtype=np.int32)), pa.array(leaf[rows].astype(np.int32)), pa.ListArray.from_arrays(ends, x[rows].ravel()), pa.array(y[rows]), pa.array(w[rows]), pa.array(h[rows])],
                    ["tree", "node", "x", "y", "w", "h"],
                )

    return data.select("h", "x", "y").mapInArrow(run, "tree int, node int, x array<double>, y double, w double, h long")


def _routed_blobs(data: DataFrame, tops: list[Top], d: int, spec: TreeSpec, trees: range | None = None) -> DataFrame:
    """The rows of each part in every tree (of ``trees``) that draws them, packed: a row per part and batch."""
    trees = range(spec.trees) if trees is None else trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, h in _large_batches(batches, d):
            for tree in trees:
                w = row_weights(h, tree, spec)
                for node, rows in _by_node(tops[tree].leaves(x), np.flatnonzero(w > 0)):
                    packed = [x[rows], y[rows], w[rows].astype(np.uint8), h[rows]]
                    cols = [pa.array([tree], pa.int32()), pa.array([node], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in packed]]
                    yield pa.RecordBatch.from_arrays(cols, ["tree", "node", "x", "y", "w", "h"])

    return data.select("h", "x", "y").mapInArrow(run, "tree int, node int, x binary, y binary, w binary, h binary")


def _by_node(leaf: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The ``rows`` of each leaf."""
    rows = rows[np.argsort(leaf[rows], kind="stable")]
    own = leaf[rows]
    for part in np.split(rows, np.flatnonzero(own[1:] != own[:-1]) + 1) if len(rows) else []:
        yield int(leaf[part[0]]), part


def _unpacked(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_py(), dtype=dtype) for v in column] or [np.zeros(0, dtype)])


# --- forests ------------------------------------------------------------------------------

_PART = "tree int, node int, blob binary"


class Forest:
    """Trees as tops and a table of parts; ``gains`` is the loss that each feature took away."""

    kind = "forest"

    def __init__(self, spec: TreeSpec, d: int, tops: list[Top], parts: DataFrame | None, gains: np.ndarray, data: DataFrame | None = None, n: int = 0):
        """Without ``parts`` these are grown from the ``n`` rows of ``data`` whenever they are needed, and
        ``gains`` are those of the tops only."""
        self.spec, self.d, self.tops, self.parts, self.gains = spec, d, tops, parts, gains
        self.data, self.n = data, n
        self.all_gains = gains if data is None else None

    def importance(self) -> np.ndarray:
        gains = self._every_gain()
        total = gains.sum()
        return gains / total if total > 0 else gains

    def _every_gain(self) -> np.ndarray:
        if self.all_gains is None:
            with shuffles_dropped(self.data.sparkSession):
                more = [_gains(self._grown(trees).select("gain"), self.d) for trees in self._rounds(0)]
            self.all_gains = self.gains + np.sum(more, axis=0)
        return self.all_gains

    def _rounds(self, tree_bytes: float) -> list[range]:
        """The trees that are handled together, given the bytes a tree takes beside its growth."""
        if self.data is not None:
            tree_bytes += _grown_bytes(self.n, self.d, self.spec)
        step = _trees_a_round(tree_bytes)
        return [range(t, min(t + step, self.spec.trees)) for t in range(0, self.spec.trees, step)]

    def _grown(self, trees: range) -> DataFrame:
        return _grown(self.data, self.tops, self.d, self.spec, trees)

    def outputs(self, df: DataFrame, x: str = "x") -> DataFrame:
        """``df`` with ``outputs``: the mean over trees of the label, or of the shares of classes."""
        if self.data is not None:
            return self._by_part(df, x)
        size = self.parts.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0]
        return self._by_model(df, x) if size <= MODEL_BYTES else self._by_part(df, x, size)

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Adds ``prediction`` and, for classes, ``probability``; equal shares go to the smaller class."""
        out = self.outputs(df, x)
        if self.spec.classes is None:
            return out.withColumn("prediction", F.col("outputs")[0]).drop("outputs")
        best = F.array_position("outputs", F.array_max("outputs")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumnRenamed("outputs", "probability")

    def _by_model(self, df: DataFrame, x: str) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast([(r.tree, r.node, bytes(r.blob)) for r in self.parts.collect()])
        tops, d, trees, width = self.tops, self.d, self.spec.trees, self.spec.classes or 1
        schema = T.StructType([*df.schema.fields, T.StructField("outputs", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = {}
            for tree, node, blob in held.value:
                parts.setdefault(tree, {})[node] = Part.read(blob)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                m = _matrix(batch.column(x), d)
                total = np.zeros((len(m), width))
                for tree in range(trees):
                    leaf = tops[tree].leaves(m)
                    for node in np.unique(leaf).tolist():
                        rows = np.flatnonzero(leaf == node)
                        total[rows] += parts[tree][node].predict(m[rows])
                ends = np.arange(len(m) + 1, dtype=np.int32) * width
                out = pa.ListArray.from_arrays(ends, (total / trees).ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "outputs"])

        return df.mapInArrow(run, schema)

    def _by_part(self, df: DataFrame, x: str, size: int = 0) -> DataFrame:
        """A row meets its part in every tree by key; parts with many rows are cut into chunks. ``size``:
        bytes of all parts, if they are held."""
        spark, d, width = df.sparkSession, self.d, self.spec.classes or 1
        rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(start, BLOCK_ROWS)
                    ids = part.column("__row").to_numpy()
                    values = [ids[0], len(ids), ids.tobytes(), _matrix(part.column("x"), d).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "n", "ids", "x"])

        blocks = cut_lineage(rows.select("__row", F.col(x).alias("x")).mapInArrow(pack, "block long, n long, ids binary, x binary"))
        asked = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        counts = self._asked_chunks(blocks, asked)
        rounds = self._rounds(asked * (8 * d + 8 * width + 8) + 2 * size / self.spec.trees)
        with scratch_folder(spark) as folder, shuffles_dropped(spark):
            total = blocks.select("block", "n", F.lit(b"").alias("total"))
            for i, trees in enumerate(rounds):
                parts = self.parts
                if self.data is not None:
                    self._grown(trees).select("tree", "node", "blob").write.parquet(f"{folder}/parts-{i}")
                    parts = spark.read.parquet(f"{folder}/parts-{i}")
                found = self._found(blocks, parts, counts, trees)
                self._added(total, found).write.parquet(f"{folder}/total-{i}")
                total = spark.read.schema("block long, n long, total binary").parquet(f"{folder}/total-{i}")
                remove_folder(spark, f"{folder}/parts-{i}")
                remove_folder(spark, f"{folder}/total-{i - 1}")
            total = cut_lineage(blocks.select("block", "ids").join(total, "block").select("ids", "total"))
        trees = self.spec.trees

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, total in zip(batch.column("ids"), batch.column("total")):
                    ids, total = np.frombuffer(ids.as_py(), dtype=np.int64), np.frombuffer(total.as_py(), dtype=float)
                    ends = np.arange(len(ids) + 1, dtype=np.int32) * width
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, total / trees)], ["__row", "outputs"])

        return rows.join(total.mapInArrow(unpack, "__row long, outputs array<double>"), "__row").drop("__row")

    def _asked_chunks(self, blocks: DataFrame, asked: int) -> DataFrame | None:
        """tree, node and in how many chunks the rows asked of a part are cut; None if no tree has more than one part."""
        if all(len(t.feature) == 1 for t in self.tops):
            return None
        tops, d, trees = self.tops, self.d, self.spec.trees

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("x"):
                    m = np.frombuffer(blob.as_py(), dtype=float).reshape(-1, d)
                    for tree in range(trees):
                        node, n = np.unique(tops[tree].leaves(m), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), tree, dtype=np.int32)), pa.array(node.astype(np.int32)), pa.array(n)], ["tree", "node", "n"])

        with shuffles_dropped(blocks.sparkSession):
            counts = blocks.select("x").mapInArrow(count, "tree int, node int, n long").groupBy("tree", "node")
            return cut_lineage(counts.agg(F.ceil(F.sum("n") / CHUNK_ROWS).cast("int").alias("chunks")))

    def _found(self, blocks: DataFrame, parts: DataFrame, counts: DataFrame | None, trees: range) -> DataFrame:
        """block, tree, places in the block and outputs there, for all rows of ``blocks`` in each of ``trees``."""
        tops, d = self.tops, self.d

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, blob in zip(batch.column("block").to_pylist(), batch.column("x")):
                    m = np.frombuffer(blob.as_py(), dtype=float).reshape(-1, d)
                    for tree in trees:
                        for node, at in _by_node(tops[tree].leaves(m), np.arange(len(m))):
                            values = [block, tree, node, at.astype(np.int32).tobytes(), m[at].tobytes()]
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        names = ["block", "tree", "node", "at", "x"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        routed = blocks.select("block", "x").mapInArrow(route, "block long, tree int, node int, at binary, x binary")
        sized = parts.where(F.col("tree").between(trees.start, trees.stop - 1))
        if counts is None:
            chunks = F.lit(max(1, -(-blocks.agg(F.sum("n")).first()[0] // CHUNK_ROWS)))
            sized, routed = sized.withColumn("chunks", chunks), routed.withColumn("chunks", chunks)
        else:
            sized, routed = sized.join(counts, ["tree", "node"]), routed.join(counts, ["tree", "node"])
        left = sized.select("tree", "node", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"), "blob")
        right = routed.select("tree", "node", F.pmod(F.xxhash64("block"), F.col("chunks").cast("int")).cast("int").alias("chunk"), "block", "at", "x")

        def score(model: pa.Table, asked: pa.Table) -> pa.Table:
            out = {"block": [], "tree": [], "at": [], "got": []}
            if model.num_rows and asked.num_rows:
                part = Part.read(model.column("blob")[0].as_py())
                out = {"block": asked.column("block"), "tree": asked.column("tree"), "at": asked.column("at")}
                held = [np.frombuffer(v.as_py(), dtype=float) for v in asked.column("x")]
                lens = [len(v.as_py()) // 4 for v in asked.column("at")]
                out["got"] = [part.predict(v.reshape(n, d)).tobytes() for v, n in zip(held, lens)]
            return pa.table([pa.array(out[c], t) if isinstance(out[c], list) else out[c] for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], list(out))

        keys = ["tree", "node", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "block long, tree int, at binary, got binary")

    def _added(self, total: DataFrame, found: DataFrame) -> DataFrame:
        """The sums of each block with the outputs found added, tree after tree."""
        width = self.spec.classes or 1

        def add(own: pa.Table, found: pa.Table) -> pa.Table:
            block, n, before = (own.column(c)[0].as_py() for c in ("block", "n", "total"))
            out = np.frombuffer(before, dtype=float).reshape(n, width).copy() if before else np.zeros((n, width))
            for i in np.argsort(found.column("tree").to_numpy(), kind="stable").tolist():
                at = np.frombuffer(found.column("at")[i].as_py(), dtype=np.int32)
                out[at] += np.frombuffer(found.column("got")[i].as_py(), dtype=float).reshape(len(at), width)
            return pa.table([pa.array([block]), pa.array([n]), pa.array([out.tobytes()], pa.binary())], ["block", "n", "total"])

        return total.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(add, "block long, n long, total binary")

    def save(self, path: str) -> None:
        tops = [(t, n, top.feature[n], top.cut[n], top.left[n], top.level[n]) for t, top in enumerate(self.tops) for n in range(len(top.feature))]
        spark = SparkSession.active()
        spark.createDataFrame(tops, "tree int, node int, feature int, cut double, left int, level int").write.mode("overwrite").parquet(f"{path}/tops")
        if self.data is None:
            self.parts.write.mode("overwrite").parquet(f"{path}/parts")
            return
        with shuffles_dropped(spark):
            for i, trees in enumerate(self._rounds(0)):
                self._grown(trees).write.mode("append" if i else "overwrite").parquet(f"{path}/parts")
        self.all_gains = self.gains + _gains(spark.read.parquet(f"{path}/parts"), self.d)

    def meta(self) -> dict:
        return {"trees": self.spec.trees, "classes": self.spec.classes, "d": self.d, "gains": self._every_gain().tolist()}

    @staticmethod
    def load(spark: SparkSession, path: str, meta: dict) -> Forest:
        tops = [Top([], [], [], [], []) for _ in range(meta["trees"])]
        for r in spark.read.parquet(f"{path}/tops").orderBy("tree", "node").collect():
            top = tops[r["tree"]]
            top.feature.append(r["feature"])
            top.cut.append(r["cut"])
            top.left.append(r["left"])
            top.value.append(None)
            top.level.append(r["level"])
        spec = TreeSpec(trees=meta["trees"], classes=meta["classes"])
        parts = spark.read.parquet(f"{path}/parts").select("tree", "node", "blob")
        return Forest(spec, meta["d"], tops, parts, np.array(meta["gains"]))


def fit_forest(rows: DataFrame, key: str, spec: TreeSpec, x: str = "x", y: str = "label") -> Forest:
    """``rows`` has the key, an array of features without nulls, and a label (classes from 0)."""
    spark = rows.sparkSession
    rows = rows.where(F.col(y).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    data = cut_lineage(_packed(rows))
    size = data.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("d").alias("d")).first()
    n, d = size["n"], size["d"] or 0
    if n == 0:
        raise ValueError("no rows to train on")
    if spec.finish_rows is None:
        spec = replace(spec, finish_rows=min(1_000_000, max(100_000, n // 64)))
    if spec.trees > 1 and 8 * n * (d + 2) <= spec.shared_bytes:
        tops, gains = [Top() for _ in range(spec.trees)], np.zeros(d)
        parts = _whole_trees(spark, data, d, spec)
    else:
        with shuffles_dropped(spark):
            tops, gains = _split_large(data, rows, n, d, spec)
        if _trees_a_round(_grown_bytes(n, d, spec)) < spec.trees:
            return Forest(spec, d, tops, None, gains, data, n)
        parts = _grown(data, tops, d, spec, range(spec.trees))
    with shuffles_dropped(spark):
        parts = cut_lineage(parts)
    return Forest(spec, d, tops, parts.select("tree", "node", "blob"), gains + _gains(parts, d))


def _trees_a_round(tree_bytes: float) -> int:
    return max(1, int(ROUND_BYTES // max(tree_bytes, 1.0)))


def _grown_bytes(n: int, d: int, spec: TreeSpec) -> float:
    """Bound of the rows sent to the parts of one tree and of its parts: two nodes a row, written and sent on."""
    drawn = n * (0.64 if spec.bootstrap else 1.0)
    return drawn * (8 * (d + 2) + 1 + 2 * (28 + 8 * (spec.classes or 0)))


def _gains(parts: DataFrame, d: int) -> np.ndarray:
    if d == 0:
        return np.zeros(0)
    got = parts.agg(*[F.sum(F.col("gain")[j]).alias(f"g{j}") for j in range(d)]).first()
    return np.array([g or 0.0 for g in got])


def _grown(data: DataFrame, tops: list[Top], d: int, spec: TreeSpec, trees: range) -> DataFrame:
    """tree, node, blob and gain of all parts of ``trees``."""

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        tree, node = key[0].as_py(), key[1].as_py()
        depth = None if spec.max_depth is None else spec.max_depth - tops[tree].level[node]
        # One order of rows whatever the shuffle did, so that sums and trees repeat exactly.
        at = np.argsort(_unpacked(table.column("h"), np.int64), kind="stable")
        x = _unpacked(table.column("x"), float).reshape(len(at), d)[at]
        y, w = _unpacked(table.column("y"), float)[at], _unpacked(table.column("w"), np.uint8)[at].astype(float)
        part = grow(x, y, w, spec, [spec.seed, tree, node], depth)
        return _part_row(tree, node, part)

    return _routed_blobs(data, tops, d, spec, trees).groupBy("tree", "node").applyInArrow(finish, f"{_PART}, gain array<double>")


def _part_row(tree: int, node: int, part: Part) -> pa.Table:
    gain = pa.array([part.gain.tolist()], pa.list_(pa.float64()))
    return pa.table([pa.array([tree], pa.int32()), pa.array([node], pa.int32()), pa.array([part.blob()], pa.binary()), gain], ["tree", "node", "blob", "gain"])


def _whole_trees(spark: SparkSession, data: DataFrame, d: int, spec: TreeSpec) -> DataFrame:
    """Every tree in a task of its own, from a training set whose size was checked."""
    x, y, h = _arrays(data.toArrow(), d)
    at = np.argsort(h, kind="stable")
    held = spark.sparkContext.broadcast((np.ascontiguousarray(x[at]), y[at], h[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                x, y, h = held.value
                w = row_weights(h, tree, spec)
                own = w > 0
                part = grow(x[own], y[own], w[own], spec, [spec.seed, tree, 0], spec.max_depth)
                yield from _part_row(tree, 0, part).to_batches()

    return spark.range(spec.trees).repartition(spec.trees, "id").mapInArrow(run, f"{_PART}, gain array<double>")
