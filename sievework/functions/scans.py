"""Scans along ordered series of any length: moving windows, positions and linear recurrences.

All rows are sorted once by range over (series, order, tie), so a long series lies in consecutive
partitions. A partition needs of the others only what its first run of rows continues and its last run
runs into: how many rows came before, the state of the recurrence s <- keep * s + value there, the last
values before it and the first values after it. One small record per partition says that; the records
are combined in order on the driver (a partition that holds one series alone passes on what it got), and
a second pass over the sorted rows finishes each partition from its carry.

Work is linear in the rows, a task holds the numbers of one partition, and the driver one record per
partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievework.session import cut_lineage, parallelism

EDGES = "part int, place int, key array<string>, rows long, total double, weight double, head array<double>, tail array<double>"


@dataclass
class Run:
    """Rows of one series in one partition, and what came before and after them.

    ``values`` has NaN for NULL. ``left`` and ``right`` hold up to as many neighbours as asked for;
    ``position`` rows came before; ``total`` and ``weight`` are the decayed sum and weight so far.
    """

    values: np.ndarray
    left: np.ndarray = field(default_factory=lambda: np.zeros(0))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0))
    position: int = 0
    total: float = 0.0
    weight: float = 0.0


@dataclass
class _Edge:
    """What a run passes on: its size, state from nothing, and the values at both ends."""

    key: tuple
    rows: int
    total: float
    weight: float
    head: np.ndarray
    tail: np.ndarray


def decayed(values: np.ndarray, keep: float, total: float = 0.0, weight: float = 0.0) -> tuple[list[float], list[float]]:
    """Decayed sums and weights after every value; a NaN only ages the others."""
    totals, weights = [], []
    for v in values.tolist():
        total, weight = total * keep, weight * keep
        if v == v:
            total, weight = total + v, weight + 1.0
        totals.append(total)
        weights.append(weight)
    return totals, weights


def scan_series(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    outputs: dict[str, str],
    fn: Callable[[Run], dict[str, np.ndarray]],
    before: int = 0,
    after: int = 0,
    keep: float | None = None,
    tie: str | None = None,
) -> DataFrame:
    """``df`` with the columns ``outputs`` (name to type) that ``fn`` makes of every run; NaN becomes NULL.

    Rows are in the order of (order, tie or value) within their series.
    """
    keys = list(keys)
    by = [*keys, order, tie or value]
    n = parallelism(df)
    rows = df.withColumn("__v", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))))
    rows = cut_lineage(rows.repartitionByRange(n, *by).sortWithinPartitions(*by))
    at = [rows.columns.index(k) for k in keys]

    def runs(table: pa.Table) -> Iterator[tuple[tuple, int, int]]:
        """(key, start, end) of the runs of a partition."""
        size = table.num_rows
        cut = np.zeros(size, dtype=bool)
        if size:
            cut[0] = True
        for k in at:
            column = table.column(k).combine_chunks()
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cut[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(cut)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), size]):
            yield tuple(repr(table.column(k)[s].as_py()) for k in at), s, e

    def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
        held = [b for b in batches if b.num_rows]
        return pa.Table.from_batches(held) if held else None

    form = to_arrow_schema(T.StructType.fromDDL(EDGES))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole(batches)
        if table is None:
            return
        v = table.column("__v").to_numpy()
        found = list(runs(table))
        out = []
        for place, (key, s, e) in enumerate(found):
            if place not in (0, len(found) - 1):
                continue
            own = v[s:e]
            t, w = decayed(own, keep) if keep is not None else ([0.0], [0.0])
            out.append((TaskContext.get().partitionId(), place, list(key), e - s, t[-1], w[-1], own[:after].tolist(), own[len(own) - min(before, len(own)) :].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), form)], schema=form)

    carries = _carries(rows.mapInArrow(edges, EDGES).collect(), before, after, keep or 0.0)
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in outputs.items())).fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole(batches)
        if table is None:
            return
        v = table.column("__v").to_numpy()
        left, right = carries.get(TaskContext.get().partitionId(), (None, None))
        made: dict[str, list[np.ndarray]] = {c: [] for c in outputs}
        found = list(runs(table))
        for place, (_, s, e) in enumerate(found):
            run = Run(v[s:e])
            if place == 0 and left is not None:
                run.left, run.position, run.total, run.weight = left.tail, left.rows, left.total, left.weight
            if place == len(found) - 1 and right is not None:
                run.right = right
            for c, column in fn(run).items():
                made[c].append(np.asarray(column))
        columns = [pa.array(np.concatenate(made[c]), from_pandas=True) for c in outputs]
        out = pa.Table.from_arrays([*table.drop_columns(["__v"]).columns, *columns], [*table.column_names[:-1], *outputs])
        yield from out.to_batches(max_chunksize=65_536)

    return rows.mapInArrow(finish, schema)


def _carries(records: list, before: int, after: int, keep: float) -> dict[int, tuple[_Edge | None, np.ndarray | None]]:
    """For every partition what its first run continues, and the values that follow its last run."""
    parts: dict[int, list[_Edge]] = {}
    for r in sorted(records, key=lambda r: (r["part"], r["place"])):
        edge = _Edge(tuple(r["key"]), r["rows"], r["total"], r["weight"], np.array(r["head"], dtype=float), np.array(r["tail"], dtype=float))
        parts.setdefault(r["part"], []).append(edge)
    out: dict[int, tuple[_Edge | None, np.ndarray | None]] = {}
    carry: _Edge | None = None
    for part in sorted(parts):
        own = parts[part]
        left = carry if carry is not None and carry.key == own[0].key else None
        out[part] = (left, None)
        last = own[-1]
        if len(own) == 1 and left is not None:
            aged = keep**last.rows
            tail = np.concatenate([left.tail, last.tail])
            last = _Edge(last.key, left.rows + last.rows, left.total * aged + last.total, left.weight * aged + last.weight, last.head, tail[len(tail) - min(before, len(tail)) :])
        carry = last
    follow: tuple[tuple, np.ndarray] | None = None
    for part in sorted(parts, reverse=True):
        own = parts[part]
        right = follow[1] if follow is not None and follow[0] == own[-1].key else None
        out[part] = (out[part][0], right)
        head = own[0].head
        if len(own) == 1 and right is not None:
            head = np.concatenate([head, right])[:after]
        follow = (own[0].key, head)
    return out


# --- what the scans are used for ------------------------------------------------------------


def moving_sums(run: Run, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and number of the known values from ``before`` rows back to ``after`` ahead, and the run with its borders."""
    v = np.concatenate([run.left, run.values, run.right])
    known = ~np.isnan(v)
    start = len(run.left)
    at = np.arange(start, start + len(run.values))
    low, high = np.maximum(at - before, 0), np.minimum(at + after + 1, len(v))
    # Sums over blocks of the window's length, so that rounding does not grow along the run.
    sums = _window_sums(np.where(known, v, 0.0), low, high, before + after + 1)
    counts = np.concatenate([[0], np.cumsum(known)])
    return sums, counts[high] - counts[low], v


def _window_sums(v: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """v[low:high].sum() for windows of at most ``width``: a suffix of one block and a prefix of the next."""
    size = -(-len(v) // width) * width
    blocks = np.zeros(size)
    blocks[: len(v)] = v
    blocks = blocks.reshape(-1, width)
    prefix = np.cumsum(blocks, axis=1).ravel()
    suffix = np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = high - 1
    same = low // width == last // width
    inside = prefix[last] - np.where(low % width > 0, prefix[np.maximum(low - 1, 0)], 0.0)
    return np.where(same, inside, suffix[low] + prefix[last])


def moving_mean(run: Run, rows: int) -> np.ndarray:
    """Mean of the last ``rows`` points, NaN where they are not all there."""
    sums, counts, _ = moving_sums(run, rows - 1, 0)
    return np.where(counts == rows, sums / rows, np.nan)


def centred_mean(run: Run, period: int) -> np.ndarray:
    """Mean over one period about each point, half weight at both ends of an even one."""
    half = period // 2
    sums, counts, v = moving_sums(run, half, half)
    if period % 2 == 0:
        at = np.arange(len(run.left), len(run.left) + len(run.values))
        first = np.where(at - half >= 0, v[np.maximum(at - half, 0)], np.nan)
        last = np.where(at + half < len(v), v[np.minimum(at + half, len(v) - 1)], np.nan)
        sums = sums - (first + last) / 2
    return np.where(counts == 2 * half + 1, sums / period, np.nan)


def exponential_means(run: Run, keep: float) -> np.ndarray:
    """Decayed sum over decayed weight; NaN before the first known value."""
    totals, weights = decayed(run.values, keep, run.total, run.weight)
    t, w = np.array(totals), np.array(weights)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(w > 0, t / w, np.nan)
