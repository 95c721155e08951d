"""Exact neighbour search without pairing every row with every other.

Points are put into cells whose number grows with the points.  A query point travels only to the
cells that can hold a neighbour; crowded cells are cut into blocks of bounded size.  Inside a block
the distances are one numpy calculation that returns the few rows that matter, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sievework.functions.exprs import text_columns
from sievework.operators.encode import label_dictionary
from sievework.operators.missing import fill_mode
from sievework.session import Scratch, cut_lineage, scratch_folder, shuffles_dropped, union_rows

BLOCK = 2048
MAX_PIVOTS = 256
#: Points of more columns are searched block by block.
WIDE = 8
#: Points from which regions are cut, held by the driver.
MAX_SAMPLE = 1_000_000
#: Queries that are searched and voted on together: bounds the tables between the steps on disk.
SLICE_ROWS = 8_000_000


def as_points(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, one dimension at a time so that memory stays at one block."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        diff *= diff
        out += diff
    return out


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in x]) if len(x) else np.zeros((0, 1))


class _Pivots:
    """Cells around a bounded number of sample points, with their sizes and radii."""

    def __init__(self, points: DataFrame, n: int):
        wanted = int(min(MAX_PIVOTS, max(1, n // BLOCK)))
        rows = points.orderBy(F.xxhash64("id")).limit(wanted).select("x").distinct().collect()
        self.centres = np.array([r["x"] for r in rows], dtype=float)
        # Read by the statistics and by each search step: written once.
        self.members = cut_lineage(self.assign(points))
        self.size = np.zeros(len(self.centres), dtype=np.int64)
        self.radius = np.zeros(len(self.centres))
        for r in self.members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("to_centre").alias("r")).collect():
            self.size[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]

    def assign(self, points: DataFrame) -> DataFrame:
        """Add the nearest centre as ``cell`` and the distance ``to_centre``."""
        centres = self.centres

        @F.pandas_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())]))
        def nearest(x: pd.Series) -> pd.DataFrame:
            d2 = _distances(_stack(x), centres)
            cell = d2.argmin(axis=1)
            return pd.DataFrame({"cell": cell.astype("int32"), "dist": np.sqrt(d2[np.arange(len(cell)), cell])})

        return points.withColumn("_c", nearest("x")).select(
            *points.columns, F.col("_c.cell").alias("cell"), F.col("_c.dist").alias("to_centre")
        )

    def reachable(self, cell: str, bound: str) -> Column:
        """Cells other than the point's own that can hold a point within ``bound`` (NULL: any).

        A cell is out of reach if its ball is, or if the plane half way between its centre and
        the point's own centre is.
        """
        centres, radius, size = self.centres, self.radius, self.size
        apart = np.sqrt(_distances(centres, centres))

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def cells(x: pd.Series, own: pd.Series, limit: pd.Series) -> pd.Series:
            d2 = _distances(_stack(x), centres)
            at = own.to_numpy(dtype=int)
            rows = np.arange(len(at))
            ball = np.sqrt(d2) - radius
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d2 - d2[rows, at][:, None]) / (2.0 * apart[at])
            plane[rows, at] = 0.0
            far = limit.fillna(np.inf).to_numpy(dtype=float)[:, None]
            keep = (np.maximum(ball, plane) <= far * (1 + 1e-9) + 1e-9) & (size > 0)
            keep[rows, at] = False
            return pd.Series([np.flatnonzero(row).astype("int32").tolist() for row in keep])

        return cells("x", cell, bound)


def _cogroup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], fn, out: T.StructType, blocks: int, arrow: bool = False
) -> DataFrame:
    """Cogroup with a partition per expected block, up to the session's shuffle partitions.

    Blocks are small in bytes but heavy to compute, so run-time merging of small partitions
    would leave most cores idle.
    """
    n = max(1, min(blocks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    a, b = left.repartition(n, *keys), right.repartition(n, *keys)
    both = a.groupBy(*keys).cogroup(b.groupBy(*keys))
    return both.applyInArrow(fn, out) if arrow else both.applyInPandas(fn, out)


class _Regions:
    """Boxes cut at medians of a sample until each has about half a BLOCK of points; each keeps at
    least ``k`` sampled points, so that it is never short of neighbours."""

    def __init__(self, sample: np.ndarray, n: int, k: int):
        d = sample.shape[1]
        least = max(k, int(np.ceil(len(sample) * max(1, BLOCK // 2) / max(n, 1))))
        self.feature, self.cut, self.left = [-1], [0.0], [0]
        self.low, self.high = [np.full(d, -np.inf)], [np.full(d, np.inf)]
        todo = [(0, sample)]
        while todo:
            node, x = todo.pop()
            if len(x) < 2 * least:
                continue
            for j in np.argsort(x.min(axis=0) - x.max(axis=0), kind="stable"):
                v = np.sort(x[:, j])
                cut = v[(len(v) - 1) // 2]
                if cut == v[-1]:
                    below = v[v < cut]
                    if len(below) == 0:
                        continue
                    cut = below[-1]
                goes = x[:, j] <= cut
                if min(goes.sum(), len(x) - goes.sum()) < least:
                    continue
                self.feature[node], self.cut[node], self.left[node] = int(j), float(cut), len(self.feature)
                for side in (0, 1):
                    low, high = self.low[node].copy(), self.high[node].copy()
                    (low if side else high)[j] = cut
                    self.feature.append(-1)
                    self.cut.append(0.0)
                    self.left.append(0)
                    self.low.append(low)
                    self.high.append(high)
                    todo.append((len(self.feature) - 1, x[~goes] if side else x[goes]))
                break
        self.feature, self.cut, self.left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The region of each point."""
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.flatnonzero(self.feature[at] >= 0)
        while len(rows):
            node = at[rows]
            at[rows] = self.left[node] + ~(x[rows, self.feature[node]] <= self.cut[node])
            rows = rows[self.feature[at[rows]] >= 0]
        return at

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region) pairs of all regions that can hold a point within ``bound`` of the row."""
        rows, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        far = bound * (1 + 1e-9) + 1e-9
        found = []
        while len(rows):
            done = self.feature[at] < 0
            found.append((rows[done], at[done]))
            rows, at = np.repeat(rows[~done], 2), (self.left[at[~done]][:, None] + np.arange(2)).ravel()
            off = np.maximum(np.maximum(self.low[at] - x[rows], x[rows] - self.high[at]), 0.0)
            keep = ~(np.sqrt((off * off).sum(axis=1)) > far[rows])
            rows, at = rows[keep], at[keep]
        return np.concatenate([r for r, _ in found] or [rows]), np.concatenate([c for _, c in found] or [at])

    def visits(self, x: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``within`` finds, for so few rows at once that memory holds even if each reaches every region."""
        step = max(1, 1_000_000 // len(self.feature))
        for s in range(0, len(x), step):
            rows, cell = self.within(x[s : s + step], bound[s : s + step])
            yield rows + s, cell


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest_in_block(x: np.ndarray, y: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, dist) of the k nearest rows of ``y`` to each row of ``x``, nearest first, ties to the
    smaller j; with a bound, only of those within it. Memory stays at a million distances."""
    kk = min(k, len(y))
    out = []
    wide = x.shape[1] > WIDE and bool(np.isfinite(x).all() and np.isfinite(y).all())
    middle = y.mean(axis=0)
    yc = y - middle
    y2 = (yc * yc).sum(axis=1)
    # One product of matrices gives y.y - 2 x.y, which orders the members of a query.
    factors = np.ascontiguousarray(np.column_stack([-2.0 * yc, y2]).T) if wide else None
    step = max(1, 1_000_000 // len(y)) if len(y) <= 4 * BLOCK else 256
    width = max(kk, len(y) if len(y) <= 4 * BLOCK else 2 * BLOCK)
    for s in range(0, len(x), step):
        own = x[s : s + step]
        far = None if bound is None else bound[s : s + step] ** 2 * (1 + 1e-9) + 1e-18
        c = own - middle
        c2 = (c * c).sum(axis=1) if wide else np.zeros(len(own))
        ones = np.column_stack([c, np.ones(len(c))])
        i, j, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for t in range(0, len(y), width):
            part = y[t : t + width]
            if wide:
                # Products of matrices find the candidates; their distances are taken one by one below.
                near = ones @ factors[:, t : t + width]
                slack = 1e-11 * (c2 + y2.max())
            else:
                near, slack = _distances(own, part), np.zeros(len(own))
            if far is None:
                nth = min(kk, near.shape[1]) - 1
                limit = c2 + np.partition(near, nth, axis=1)[:, nth] + 2 * slack
                limit = limit * (1 + 1e-14)
                far = limit if len(part) >= kk else None
            else:
                limit = far + slack
            a, b = np.nonzero(near <= (limit - c2)[:, None])
            if len(a) == 0:
                continue
            exact = _pair_distances(own, part, a, b) if wide else near[a, b]
            i, j, d2 = np.concatenate([i, a]), np.concatenate([j, b + t]), np.concatenate([d2, exact])
            i, j, d2 = _first_k(i, j, d2, kk)
            if bound is None and len(y) > width:
                last = np.flatnonzero(np.append(i[1:] != i[:-1], True))
                full = np.bincount(i, minlength=len(own)) == kk
                if full.all():
                    far = np.minimum(far, d2[last] * (1 + 1e-14)) if far is not None else d2[last] * (1 + 1e-14)
        out.append((i + s, j, np.sqrt(d2)))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for c in range(a.shape[1]):
        diff = a[i, c] - b[j, c]
        out += diff * diff
    return out


def _first_k(i: np.ndarray, j: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((j, np.sqrt(d2), i))
    i, j, d2 = i[order], j[order], d2[order]
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
    return i[rank < k], j[rank < k], d2[rank < k]


def _best(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("dist", "donor_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_join(queries: DataFrame, donors: DataFrame, k: int) -> DataFrame:
    """(query_id, donor_id, dist, rank): the k nearest donors of each query, ties by donor id.

    Both inputs have columns ``id`` and ``x`` (array of doubles).
    """
    return _best(nearest_candidates(queries, donors, k), k)


def nearest_candidates(
    queries: DataFrame, donors: DataFrame, k: int, n_queries: int | None = None, n_donors: int | None = None
) -> DataFrame:
    """(query_id, donor_id, dist) rows that include the k nearest donors of each query.

    Of equal donors only the k smallest ids can be results.  In few columns each query first
    searches its own region; the k-th distance found there bounds which other regions it visits.
    In many columns, where regions rule nothing out, blocks of queries meet blocks of donors.
    """
    members = cut_lineage(_members(donors, k))
    asked = queries.select(F.col("id").alias("query_id"), "x")
    first_row = members.first()
    n = members.count()
    n_queries = queries.count() if n_queries is None else n_queries
    if first_row is None or len(first_row["y"]) > WIDE or n <= BLOCK:
        return _search_blocks(asked, members, k, n_queries, n)
    index = _RegionIndex(members, k, n)
    return index.candidates(cut_lineage(index.placed(asked, "x")))


def _members(donors: DataFrame, k: int) -> DataFrame:
    """(donor_id, y) without copies of a point that can be no result."""
    copies = Window.partitionBy("y").orderBy("donor_id")
    members = donors.select(F.col("id").alias("donor_id"), F.col("x").alias("y"))
    return members.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= k).drop("_r")


def _search_blocks(asked: DataFrame, members: DataFrame, k: int, n_queries: int, n: int) -> DataFrame:
    side = int(min(16 * BLOCK, max(BLOCK, (n_queries * n / 64) ** 0.5)))
    n_q, n_d = max(1, -(-n_queries // side)), max(1, -(-n // side))
    q = asked.withColumn("_qs", F.pmod(F.xxhash64("query_id", "x"), F.lit(n_q)).cast("int"))
    d = members.withColumn("_ds", F.pmod(F.xxhash64("donor_id", "y"), F.lit(n_d)).cast("int"))
    q = q.withColumn("_ds", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
    d = d.withColumn("_qs", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    return _flat_search(q, d, ["_qs", "_ds"], k, n_q * n_d)


def _pair_schema(asked: DataFrame, members: DataFrame) -> T.StructType:
    ids = [("query_id", asked.schema["query_id"].dataType), ("donor_id", members.schema["donor_id"].dataType)]
    return T.StructType([T.StructField(n, t) for n, t in ids] + [T.StructField("dist", T.DoubleType())])


def _flat_search(q: DataFrame, d: DataFrame, keys: Sequence[str], k: int, blocks: int) -> DataFrame:
    """The k nearest members of each query (within its ``bound``, if it has one) in each block."""
    names = ["query_id", "donor_id", "dist"]
    bounded = "bound" in q.columns
    types = [q.schema["query_id"].dataType, d.schema["donor_id"].dataType, T.DoubleType()]
    empty = pa.table([pa.array([], to_arrow_type(t)) for t in types], names)

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return empty
        right = right.sort_by([("donor_id", "ascending")])
        bound = left.column("bound").to_numpy() if bounded else None
        i, j, dist = _nearest_in_block(_matrix(left.column("x")), _matrix(right.column("y")), k, bound)
        return pa.table([left.column("query_id").take(pa.array(i)), right.column("donor_id").take(pa.array(j)), pa.array(dist)], names)

    return _cogroup(q, d, keys, block, _pair_schema(q, d), blocks, arrow=True)


class _RegionIndex:
    """``members`` by region. ``keep`` writes a table and returns the written copy."""

    def __init__(self, members: DataFrame, k: int, n: int, keep: Callable[[DataFrame], DataFrame] = cut_lineage):
        wanted = min(n, MAX_SAMPLE, max(1, 2 * n // BLOCK) * max(8, 2 * k))
        share = int(np.ceil(wanted / n * 2**31))
        drawn = members.where(F.pmod(F.xxhash64("donor_id", "y"), F.lit(2**31)) < share).select("y").toArrow()
        self.regions = members.sparkSession.sparkContext.broadcast(_Regions(_matrix(drawn.column("y")), n, k))
        self.k, self.members = k, keep(self.placed(members, "y"))

    def placed(self, rows: DataFrame, column: str) -> DataFrame:
        regions = self.regions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = regions.value.own(_matrix(batch.column(column)))
                    yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))

    def candidates(self, own: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
        """(query_id, donor_id, dist) rows that include the k nearest members of each placed query."""
        members, k, regions = self.members, self.k, self.regions
        blocks = len(regions.value.feature)

        def parted(q: DataFrame) -> tuple[DataFrame, DataFrame]:
            # Regions hold few members, but any number of queries may fall on one. There are no more hot
            # regions than the driver holds, so neither side is shuffled to learn of them.
            hot = q.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (16 * BLOCK)).cast("int").alias("_n")).where("_n > 1")
            hot = F.broadcast(hot.limit(MAX_SAMPLE))
            q = q.join(hot, "cell", "left").withColumn("_qs", F.pmod(F.xxhash64("query_id", "x"), F.coalesce("_n", F.lit(1))).cast("int"))
            d = members.join(hot, "cell", "left").withColumn("_qs", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)))
            return q.drop("_n"), d.drop("_n")

        keys = ["cell", "_qs"]
        fields = {f.name: f for f in [*own.schema.fields, *members.schema.fields]}
        lists = [T.StructField("donors", T.ArrayType(fields["donor_id"].dataType)), T.StructField("dists", T.ArrayType(T.DoubleType()))]
        out = T.StructType([fields["query_id"], fields["x"], fields["cell"], T.StructField("bound", T.DoubleType()), *lists])
        empty = pa.table([pa.array([], to_arrow_type(f.dataType)) for f in out.fields], out.names)

        def start(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows == 0:
                return empty
            if right.num_rows == 0:
                counts, donors, dists, bound = np.zeros(left.num_rows, int), empty.column("donors").combine_chunks().flatten(), np.zeros(0), np.full(left.num_rows, np.inf)
            else:
                right = right.sort_by([("donor_id", "ascending")])
                i, j, dists = _nearest_in_block(_matrix(left.column("x")), _matrix(right.column("y")), k)
                counts, donors = np.bincount(i, minlength=left.num_rows), right.column("donor_id").combine_chunks().take(pa.array(j))
                ends = np.cumsum(counts)
                bound = np.where(counts == k, dists[np.maximum(ends - 1, 0)], np.inf)
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            found = [pa.ListArray.from_arrays(at, donors), pa.ListArray.from_arrays(at, pa.array(dists))]
            return pa.table([left.column("query_id"), left.column("x"), left.column("cell"), pa.array(bound), *found], out.names)

        first = keep(_cogroup(*parted(own), keys, start, out, blocks, arrow=True))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                x = _matrix(batch.column("x"))
                own, numbers = batch.column("cell").to_numpy(), ~np.isnan(x).any(axis=1)
                for rows, cell in regions.value.visits(x, batch.column("bound").to_numpy()):
                    # A point that is no number is near nothing.
                    more = (cell != own[rows]) & numbers[rows]
                    rows, cell = rows[more], cell[more]
                    for s in range(0, len(rows), 50_000):
                        part = batch.select(["query_id", "x", "bound"]).take(pa.array(rows[s : s + 50_000]))
                        yield part.append_column("cell", pa.array(cell[s : s + 50_000].astype(np.int32)))

        more = first.select("query_id", "x", "cell", "bound").mapInArrow(visit, T.StructType([fields["query_id"], fields["x"], T.StructField("bound", T.DoubleType()), fields["cell"]]))
        second = _flat_search(*parted(keep(more)), keys, k, blocks)
        pairs = first.select("query_id", F.inline(F.arrays_zip(F.col("donors").alias("donor_id"), F.col("dists").alias("dist"))))
        return union_rows([pairs.toDF("query_id", "donor_id", "dist"), second])


# --- k-nearest-neighbour imputation and classification ------------------------------------


def fill_nearest(df: DataFrame, key: str, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Fill numeric gaps with the mean of the k nearest rows that know the value; text with the mode.

    Distance runs over the columns both rows know, scaled up by (all / shared) columns.  Rows
    are handled per pattern of missing columns, of which there are few, so that each search is
    an ordinary one in the shared columns.  With no comparable row the column mean is used.
    """
    text = [c for c in cols if c in text_columns(df)]
    cols = [c for c in cols if c not in text]
    if text:
        df = fill_mode(df, text)
    known = F.array(*[F.col(c).isNotNull() for c in cols])
    sizes = {tuple(r["p"]): r["n"] for r in df.groupBy(known.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = list(sizes)
    if all(all(p) for p in patterns):
        return df
    parts = {p: df.where(known == F.array(*[F.lit(v) for v in p])) for p in patterns}
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    candidates = []
    for target, name in enumerate(cols):
        for gap in (p for p in patterns if not p[target]):
            for donor in (p for p in patterns if p[target]):
                shared = [c for c, a, b in zip(cols, gap, donor) if a and b]
                if not shared:
                    continue
                near = nearest_candidates(
                    as_points(parts[gap], key, shared), as_points(parts[donor], key, shared), k, sizes[gap], sizes[donor]
                )
                scale = float(np.sqrt(len(cols) / len(shared)))
                candidates.append(
                    near.select("query_id", "donor_id", (F.col("dist") * scale).alias("dist"), F.lit(target).alias("_col"))
                )
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(means[f"m{i}"])) for i, c in enumerate(cols)}
    if not candidates:
        return df.withColumns(filled)
    # One ranking over all columns at once, then one join for the donors' values.
    rank = F.row_number().over(Window.partitionBy("query_id", "_col").orderBy("dist", "donor_id"))
    best = union_rows(candidates).withColumn("_r", rank).where(F.col("_r") <= k)
    values = df.select(F.col(key).alias("donor_id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_values"))
    picked = best.join(values, "donor_id").withColumn("_v", F.col("_values")[F.col("_col")])
    wide = picked.groupBy(F.col("query_id").alias("_key")).agg(
        *[F.avg(F.when(F.col("_col") == i, F.col("_v"))).alias(f"_f{i}") for i in range(len(cols))]
    )
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.col(f"_f{i}"), F.lit(means[f"m{i}"])) for i, c in enumerate(cols)
    }
    return df.join(wide, F.col(key) == F.col("_key"), "left").withColumns(filled).select(*df.columns)


def classify_nearest(train: DataFrame, test: DataFrame, label: str, k: int = 5, weights: str = "uniform") -> DataFrame:
    """(id, prediction) by vote of the k nearest training points; ties go to the smaller label.

    ``train`` has columns id, x and the label; ``test`` has id and x.
    """
    asked, donors = test.select("id", "x"), train.select("id", "x")
    first_row = donors.first()
    if first_row is None or len(first_row["x"]) > WIDE:
        return _votes(nearest_join(asked, donors, k), train, label, weights)
    asked = asked.withColumnRenamed("id", "query_id")
    spark, n_queries = test.sparkSession, asked.count()
    slices = max(1, -(-n_queries // SLICE_ROWS))
    with scratch_folder(spark) as folder, shuffles_dropped(spark):
        # What a step has written and what it has shuffled go when the next one has been written.
        keep = Scratch(spark, folder)
        members = keep(_members(donors, k))
        n = members.count()
        if n <= BLOCK:
            near = _search_blocks(asked, members, k, n_queries, n)
            return cut_lineage(_votes(_best(near, k), train, label, weights))
        index = _RegionIndex(members, k, n, keep)
        keep.drop(1, 1)
        own = keep(index.placed(asked, "x"))
        for i in range(slices):
            made = keep.made
            part = own.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i) if slices > 1 else own
            near = keep(_best(index.candidates(part, keep), k).select("query_id", "donor_id", "dist"))
            keep.drop(made + 1, keep.made - 1)
            _votes(near, train, label, weights).write.mode("append").parquet(f"{folder}/votes")
            keep.drop(keep.made, keep.made)
        return cut_lineage(spark.read.parquet(f"{folder}/votes"))


def _votes(near: DataFrame, train: DataFrame, label: str, weights: str) -> DataFrame:
    """(id, prediction) from the nearest training points of each query."""
    labelled = near.join(train.select(F.col("id").alias("donor_id"), F.col(label).alias("_label")), "donor_id")
    if weights == "distance":
        # A training point at distance 0 outvotes all others.
        w = F.when(F.col("dist") > 0, 1 / F.col("dist")).otherwise(F.lit(1e300))
    else:
        w = F.lit(1.0)
    votes = labelled.groupBy("query_id", "_label").agg(F.sum(w).alias("_w"))
    return votes.groupBy(F.col("query_id").alias("id")).agg(
        F.min_by("_label", F.struct(-F.col("_w"), F.col("_label"))).alias("prediction")
    )


# --- density clustering -------------------------------------------------------------------


def _tile_side(points: DataFrame, eps: float, dims: int) -> float:
    """Side of square tiles: about a block of points each, halved while much of the data
    sits in crowded tiles, never below two eps."""
    ends = points.agg(
        F.count(F.lit(1)).alias("n"),
        *[e for j in range(dims) for e in (F.min(F.col("x")[j]).alias(f"lo{j}"), F.max(F.col("x")[j]).alias(f"hi{j}"))],
    ).first()
    n = max(ends["n"], 1)
    widest = max((ends[f"hi{j}"] or 0.0) - (ends[f"lo{j}"] or 0.0) for j in range(dims))
    side = max(2.0 * eps, widest * min(1.0, (BLOCK / n)) ** (1.0 / dims))
    while side >= 4.0 * eps:
        tile = F.transform("x", lambda v: F.floor(v / F.lit(side)))
        crowded = points.groupBy(tile.alias("t")).count().where(F.col("count") > 2 * BLOCK).agg(F.sum("count")).first()[0] or 0
        if crowded <= 0.1 * n:
            break
        side /= 2.0
    return side


def _tiles(points: DataFrame, eps: float, dims: int) -> tuple[DataFrame, DataFrame]:
    """Members of each tile, and visitors: every point in all tiles its eps-box touches."""
    side = _tile_side(points, eps, dims)
    home_at = [F.floor(F.col("x")[j] / side).cast("string") for j in range(dims)]
    home = points.withColumn("cell", F.concat_ws(",", *home_at))
    sent = points
    reach = eps * (1 + 1e-9)
    for j in range(dims):
        x = F.col("x")[j]
        sent = sent.withColumn(f"_t{j}", F.explode(F.sequence(F.floor((x - reach) / side), F.floor((x + reach) / side))))
    names = [f"_t{j}" for j in range(dims)]
    return home, sent.withColumn("cell", F.concat_ws(",", *[F.col(t).cast("string") for t in names])).drop(*names)


def _ball_blocks(points: DataFrame, eps: float, dims: int) -> tuple[DataFrame, DataFrame]:
    """Home and visitor rows keyed by (cell, _hs, _vs) so that each block is bounded."""
    if dims <= 3:
        home, sent = _tiles(points, eps, dims)
    else:
        pivots = _Pivots(points, points.count())
        home = pivots.members.drop("to_centre")
        others = pivots.reachable("cell", "_eps")
        sent = (
            home.withColumn("_eps", F.lit(float(eps)))
            .withColumn("cell", F.explode(F.concat(F.array("cell"), others)))
            .drop("_eps")
        )

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    sizes = blocks(home, "_hn").join(blocks(sent, "_vn"), "cell")
    h = home.join(sizes, "cell").withColumn("_hs", F.pmod(F.xxhash64("id"), F.col("_hn")).cast("int"))
    v = sent.join(sizes, "cell").withColumn("_vs", F.pmod(F.xxhash64("id"), F.col("_vn")).cast("int"))
    h = h.withColumn("_vs", F.explode(F.sequence(F.lit(0), F.col("_vn") - 1)))
    v = v.withColumn("_hs", F.explode(F.sequence(F.lit(0), F.col("_hn") - 1)))
    # Fresh names on one side: both sides come from the same rows.
    renamed = [F.col(c) if c in ("cell", "_hs", "_vs") else F.col(c).alias(f"guest_{c}") for c in v.columns if c not in ("_hn", "_vn")]
    return h.drop("_hn", "_vn"), v.select(*renamed)


def _forest(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple]:
    """For each connected part of a bipartite block: every member with the part's smallest id."""
    free_l = np.ones(len(left), dtype=bool)
    for start in range(len(left)):
        if not free_l[start]:
            continue
        in_l = np.zeros(len(left), dtype=bool)
        in_r = np.zeros(len(right), dtype=bool)
        edge = np.array([start])
        in_l[start] = True
        while len(edge):
            reach = adjacent[edge].any(axis=0) & ~in_r
            in_r |= reach
            nxt = adjacent[:, reach].any(axis=1) & ~in_l
            in_l |= nxt
            edge = np.flatnonzero(nxt)
        free_l &= ~in_l
        members = np.unique(np.concatenate([left[in_l], right[in_r]]))
        for m in members[1:]:
            yield m, members[0]


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over undirected ``a``-``b`` edges.

    Every round takes the smallest label among neighbours and then follows labels to their own
    label, and is written to the checkpoint folder.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = cut_lineage(union_rows([edges.select("a", "b"), back]).distinct())
    labels = cut_lineage(nodes.select("id", F.col("id").alias("comp")))
    while True:
        seen = (
            both.join(labels.select(F.col("id").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("comp").alias("_m"))
        )
        lower = labels.join(seen, "id", "left").select("id", F.col("comp").alias("_old"), F.least("comp", "_m").alias("comp"))
        own = lower.select(F.col("id").alias("comp"), F.col("comp").alias("_up"))
        jumped = cut_lineage(lower.join(own, "comp", "left").select("id", "_old", F.least("comp", "_up").alias("comp")))
        moved = jumped.where(F.col("comp") != F.col("_old")).limit(1).count()
        labels = jumped.select("id", "comp")
        if moved == 0:
            return labels


def _block_components(points: DataFrame, eps: float, min_points: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """(id, comp) of core points and of the points at their border, from blocks of all points in reach."""
    id_type = points.schema["id"].dataType
    h, v = _ball_blocks(points, eps, dims)
    keys = ["cell", "_hs", "_vs"]
    count_type = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType())])
    limit2 = eps * eps

    def count(home: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if len(home) == 0 or len(guests) == 0:
            return pd.DataFrame({"id": guests["guest_id"][:0], "n": np.zeros(0, dtype="int64")})
        near = _distances(_stack(guests["guest_x"]), _stack(home["x"])) <= limit2
        return pd.DataFrame({"id": guests["guest_id"].to_numpy(), "n": near @ home["w"].to_numpy()})

    blocks = 8 + 8 * points.count() // BLOCK
    counts = _cogroup(h, v, keys, count, count_type, blocks)
    core = counts.groupBy("id").agg((F.sum("n") >= min_points).alias("core"))
    marked = cut_lineage(points.join(core, "id"))

    link_type = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("core", T.BooleanType())])

    def link(home: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        home = home[home["core"]] if len(home) else home
        empty = pd.DataFrame({"a": guests["guest_id"][:0], "b": guests["guest_id"][:0], "core": np.zeros(0, dtype=bool)})
        if len(home) == 0 or len(guests) == 0:
            return empty
        near = _distances(_stack(guests["guest_x"]), _stack(home["x"])) <= limit2
        is_core = guests["guest_core"].to_numpy()
        ids, targets = guests["guest_id"].to_numpy(), home["id"].to_numpy()
        found = [(a, b, True) for a, b in _forest(near[is_core], ids[is_core], targets)]
        for i in np.flatnonzero(~is_core & near.any(axis=1)):
            found += [(ids[i], t, False) for t in targets[near[i]]]
        return pd.DataFrame(found, columns=["a", "b", "core"]) if found else empty

    h, v = _ball_blocks(marked, eps, dims)
    links = cut_lineage(_cogroup(h, v, keys, link, link_type, blocks))
    comps = connected_components(links.where("core"), marked.where("core").select("id"))
    border = (
        links.where("NOT core")
        .join(comps.select(F.col("id").alias("b"), "comp"), "b")
        .groupBy(F.col("a").alias("id"))
        .agg(F.min("comp").alias("comp"))
    )
    return comps, border


def _squared(parts: Iterable[Column]) -> Column:
    """Sum of squares, in the order of ``_distances``."""
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def _apart(a: Column, b: Column, dims: int) -> Column:
    return _squared(a[j] - b[j] for j in range(dims))


def _to_box(x: Column, low: Column, high: Column, dims: int) -> Column:
    return _squared(F.greatest(low[j] - x[j], x[j] - high[j], F.lit(0.0)) for j in range(dims))


def _grid_points(points: DataFrame, eps: float, dims: int) -> DataFrame | None:
    """Finite points with ``cell``, whose points are all within eps of each other; points in reach are at
    most two cells apart. None if that can not be: in many columns, far from zero, or if keys repeat."""
    if dims > 3 or not eps > 0:
        return None
    side = eps / dims**0.5 * (1 - 1e-6)
    finite = points.where(reduce(lambda a, b: a & b, [F.abs(F.col("x")[j]) < float("inf") for j in range(dims)]))
    ends = finite.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.max(F.greatest(F.lit(0.0), *[F.abs(F.col("x")[j]) for j in range(dims)])).alias("far")
    ).first()
    if ends["n"] == 0 or ends["ids"] < ends["n"] or ends["far"] >= side * 2**30:
        return None
    return finite.withColumn("cell", F.array(*[F.floor(F.col("x")[j] / side) for j in range(dims)]))


def _cells_around(rows: DataFrame, dims: int) -> DataFrame:
    """Every row once for each other cell that can hold a point in reach."""
    steps = [s for s in product(range(-2, 3), repeat=dims) if any(s)]
    shifts = F.explode(F.array(*[F.array(*[F.lit(v).cast("bigint") for v in s]) for s in steps])).alias("_s")
    moved = rows.select("*", shifts)
    return moved.withColumn("cell", F.array(*[F.col("cell")[j] + F.col("_s")[j] for j in range(dims)]))


def _grid_components(points: DataFrame, eps: float, min_points: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """(id, comp) of core points and of the points at their border, from cells of the grid.

    All points of a cell of ``min_points`` rows are core points; only the few points of smaller cells
    are counted. Core points of a cell are linked; two cells are linked by the outermost points of each
    in every direction, and only if those leave it open by the points that can be in reach.
    """
    limit2 = eps * eps
    reach2 = limit2 * (1 + 1e-9)
    box = [F.array(*[f(F.col("x")[j]) for j in range(dims)]).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    cells = cut_lineage(points.groupBy("cell").agg(F.sum("w").alias("cell_w"), *box))
    points = cut_lineage(points.join(cells.select("cell", "cell_w"), "cell"))
    few = F.col("cell_w") < min_points

    # Rows within eps of the points of small cells.
    asked = _cells_around(points.where(few).select(F.col("id").alias("guest"), F.col("x").alias("gx"), "cell"), dims)
    near = asked.join(cells, "cell").where(_to_box(F.col("gx"), F.col("low"), F.col("high"), dims) <= reach2)
    farthest = _squared(F.greatest(F.abs(F.col("gx")[j] - F.col("low")[j]), F.abs(F.col("gx")[j] - F.col("high")[j])) for j in range(dims))
    near = cut_lineage(near.select("guest", "gx", "cell", "cell_w", (farthest <= limit2 * (1 - 1e-9)).alias("whole")))
    single = near.where("NOT whole").select("guest", "gx", "cell").join(points.select("cell", "x", "w"), "cell")
    single = single.where(_apart(F.col("gx"), F.col("x"), dims) <= limit2).select("guest", F.col("w").alias("n"))
    counts = union_rows([near.where("whole").select("guest", F.col("cell_w").alias("n")), single]).groupBy(F.col("guest").alias("id")).agg(F.sum("n").alias("n"))
    small = points.where(few).join(counts, "id", "left")
    is_core = F.col("cell_w") + F.coalesce("n", F.lit(0)) >= min_points
    small = cut_lineage(small.select("id", "x", "cell", is_core.alias("core")))
    cores = cut_lineage(union_rows([points.where(~few).select("id", "x", "cell"), small.where("core").select("id", "x", "cell")]))

    # Cells that hold core points, with the outermost in each direction.
    ways = [v for v in product((-1, 0, 1), repeat=dims) if any(v)]
    tips = [F.max_by("x", reduce(lambda a, b: a + b, [F.col("x")[j] * float(s) for j, s in enumerate(v) if s])) for v in ways]
    held = cores.groupBy("cell").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), *box, F.array_distinct(F.array(*tips)).alias("tips"))
    held = cut_lineage(held)
    half = F.filter(F.col("_s"), lambda v: v != 0)[0] > 0
    a = _cells_around(held.select(*[F.col(c).alias(f"{c}_a") for c in held.columns], "cell"), dims).where(half)
    pair = a.join(held, "cell")
    gap = _squared(F.greatest(F.col("low")[j] - F.col("high_a")[j], F.col("low_a")[j] - F.col("high")[j], F.lit(0.0)) for j in range(dims))
    touch = F.exists("tips_a", lambda p: F.exists("tips", lambda q: _apart(p, q, dims) <= limit2))
    pair = cut_lineage(pair.where(gap <= reach2).withColumn("touch", touch))
    all_seen = (F.col("n_a") <= F.size("tips_a")) & (F.col("n") <= F.size("tips"))
    undecided = pair.where(~F.col("touch") & ~all_seen)
    keys = ["rep_a", "rep"]
    left = undecided.select(*keys, F.col("cell_a").alias("cell"), "low", "high").join(cores, "cell")
    left = left.where(_to_box(F.col("x"), F.col("low"), F.col("high"), dims) <= reach2).select(*keys, "id", "x")
    right = undecided.select(*keys, "cell", "low_a", "high_a").join(cores, "cell")
    right = right.where(_to_box(F.col("x"), F.col("low_a"), F.col("high_a"), dims) <= reach2).select(*keys, F.col("x").alias("y"))
    parts = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    left = left.join(parts, keys).withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    right = right.join(parts, keys).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = left.join(right, [*keys, "_p"]).where(_apart(F.col("x"), F.col("y"), dims) <= limit2).select(*keys)
    edges = union_rows([pair.where("touch").select(*keys), met]).toDF("a", "b")
    labels = connected_components(edges, held.select(F.col("rep").alias("id")))
    held = cut_lineage(held.join(labels.withColumnRenamed("id", "rep"), "rep").select("cell", "comp", "n", "low", "high", "tips"))
    comps = cut_lineage(cores.join(held.select("cell", "comp"), "cell").select("id", "comp"))

    # Other points of small cells take the first cluster in reach.
    rest = small.where("NOT core").select("id", F.col("x").alias("gx"), "cell")
    own = rest.join(held.select("cell", "comp"), "cell").select("id", "comp")
    seen = _cells_around(rest, dims).join(held, "cell").where(_to_box(F.col("gx"), F.col("low"), F.col("high"), dims) <= reach2)
    hit = F.exists("tips", lambda q: _apart(F.col("gx"), q, dims) <= limit2)
    seen = cut_lineage(seen.select("id", "gx", "cell", "comp", (F.col("n") <= F.size("tips")).alias("all_seen"), hit.alias("hit")))
    tried = seen.where("NOT hit AND NOT all_seen").select("id", "gx", "cell", "comp").join(cores.select("cell", "x"), "cell")
    tried = tried.where(_apart(F.col("gx"), F.col("x"), dims) <= limit2).select("id", "comp")
    border = union_rows([own, seen.where("hit").select("id", "comp"), tried]).groupBy("id").agg(F.min("comp").alias("comp"))
    return comps, border


def density_clusters(df: DataFrame, key: str, cols: Sequence[str], eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """Add ``cluster``: 0, 1, ... by smallest member key, or -1 for noise.

    A point with at least ``min_points`` rows within ``eps`` (itself included) is a core point;
    core points within eps share a cluster; other points join the first cluster in reach.
    Equal points are merged first, so a mass of copies is one weighted point.
    """
    dims = len(cols)
    x = F.array(*[F.col(c).cast("double") for c in cols])
    rows = df.withColumn("_x", x)
    points = cut_lineage(rows.groupBy(F.col("_x").alias("x")).agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("id")))
    grid = _grid_points(points, eps, dims)
    comps, border = _block_components(points, eps, min_points, dims) if grid is None else _grid_components(grid, eps, min_points, dims)
    named = union_rows([comps, border])
    codes = label_dictionary(comps, "comp").withColumnRenamed("code", "cluster")
    labels = points.join(named, "id", "left").join(codes, "comp", "left").select(
        F.col("x").alias("_x"), F.coalesce("cluster", F.lit(-1)).alias("cluster")
    )
    return rows.join(labels, "_x").select(*df.columns, "cluster")
