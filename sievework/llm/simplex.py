"""Centroid clustering with exact integer distances, filtered by n-simplex projection.

Components become the integers floor(scale * x) (64 bits; beyond that the nearest 64-bit integer).
The first centroids are the vectors with the smallest sha256 of ``<seed>:<id>`` (a null id counts as
empty), ties by components. In each round every vector goes to the nearest centroid by squared
distance (ties: smaller number) and every centroid that has vectors becomes the floor of their mean,
component by component, on exact integers; then all are assigned once more.

Some of the first centroids are pivots. The distances of a vector to the n pivots fix an apex over
the simplex that the pivots span: n - 1 coordinates in its plane and an altitude above it. They are
computed once and written with the vector. For two objects with apexes (a, h) and (b, k)

    |a - b|^2 + (h - k)^2  <=  squared distance  <=  |a - b|^2 + (h + k)^2,

so a centroid whose lower bound exceeds the least upper bound of all cannot be nearest; only the
others are compared exactly. Bounds are floating point and get a slack far above their error; the
comparison is in integers and decides alone.

A round is one pass over the written vectors that returns one sum per centroid, component and
partition; only clusters * dims sums reach the driver. Vectors that are null, of another number of components,
or with a null or non-finite component take no part. Rows are clustered one by one, repeated ids and
vectors too. With fewer vectors than clusters each starts a centroid; an empty table gives no rows.
Distances and inertias above 2^63 - 1 are given as 2^63 - 1; the assignment is exact all the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import written

LARGEST = 2**63 - 1
#: Differences of components up to this bound have squares whose sum over 2^6 components fits 64 bits.
SAFE = 2**27


@dataclass(frozen=True)
class ClusterSpec:
    clusters: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    seed: int = 1
    pivots: int = 8


@dataclass
class Clusters:
    """``rows``: id, cluster int, distance long; ``centroids``: by number, integer components."""

    rows: DataFrame
    centroids: list[list[int]]

    def inertia(self) -> list[tuple[int, int]]:
        """(cluster, sum of its distances) for every cluster that has rows."""
        sums = self.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
        return sorted((r.cluster, int(r.s)) for r in sums.collect())


def integer_vectors(vectors: DataFrame, spec: ClusterSpec, id_col: str, vector_col: str) -> DataFrame:
    """id and x (array of long): the vectors that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter((F.size(v) == spec.dims) & whole)
    return rows.select("id", F.transform(v, lambda x: F.floor(F.lit(float(spec.scale)) * x)).alias("x"))


def first_centroids(rows: DataFrame, spec: ClusterSpec) -> list[list[int]]:
    place = F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.x) for r in rows.orderBy(place, "x").limit(spec.clusters).select("x").collect()]


class Simplex:
    """Pivots and the base they span; ``project`` turns vectors into apexes."""

    def __init__(self, candidates: list[list[int]], pivots: int):
        points = np.array(candidates, dtype=np.float64)
        chosen, base = [0], np.zeros((0, points.shape[1]))
        left = points - points[0]
        longest = np.sqrt((left**2).sum(axis=1).max())
        while len(chosen) < pivots:
            # The candidate of the largest altitude over the base is the next pivot.
            altitude = np.sqrt((left**2).sum(axis=1))
            best = int(altitude.argmax())
            if not altitude[best] > 1e-3 * longest:
                break
            axis = left[best] / altitude[best]
            base = np.vstack([base, axis])
            left = left - np.outer(left @ axis, axis)
            chosen.append(best)
        self.pivots = points[chosen]
        edges = self.pivots[1:] - self.pivots[0]
        self.vertices = edges @ base.T  # coordinates of the pivots in the base: lower triangular
        self.inverse = np.linalg.inv(self.vertices) if len(edges) else np.zeros((0, 0))

    def project(self, x: np.ndarray) -> np.ndarray:
        """Apex of every row of x from its distances to the pivots: plane coordinates, then altitude."""
        x = x.astype(np.float64)
        squared = np.stack([((x - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)
        side = (squared[:, :1] - squared[:, 1:] + (self.vertices**2).sum(axis=1)) / 2
        plane = side @ self.inverse.T
        altitude = np.sqrt(np.maximum(squared[:, 0] - (plane**2).sum(axis=1), 0))
        return np.column_stack([plane, altitude])


def possible(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each vector (row) the centroids (columns) that the bounds do not rule out."""
    plane = ((apexes[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(axis=2)
    h, k = apexes[:, -1:], centres[None, :, -1]
    lower, upper = plane + (h - k) ** 2, plane + (h + k) ** 2
    slack = 1e-7 * (upper.max(axis=1, keepdims=True) + (apexes**2).sum(axis=1, keepdims=True) + (centres**2).sum(axis=1).max())
    return lower <= upper.min(axis=1, keepdims=True) + slack


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: list[list[int]], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every row, exactly."""
    biggest = max(int(np.abs(x.astype(object)).max()) if x.dtype == object else max(int(x.max()), -int(x.min())), max(abs(v) for c in centroids for v in c))
    kind = np.int64 if biggest <= SAFE and x.shape[1] <= 64 else object
    x = x.astype(kind, copy=False)
    cluster = np.zeros(len(x), dtype=np.int32)
    distance = np.full(len(x), -1, dtype=kind)
    open_ = possible(apexes, centres)
    for number, c in enumerate(centroids):
        rows = np.flatnonzero(open_[:, number])
        if len(rows) == 0:
            continue
        found = ((x[rows] - np.array(c, dtype=kind)) ** 2).sum(axis=1)
        better = (distance[rows] < 0) | (found < distance[rows])
        cluster[rows[better]] = number
        distance[rows[better]] = found[better]
    return cluster, distance


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _apexes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("apex").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def cluster(vectors: DataFrame, spec: ClusterSpec = ClusterSpec(), id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Clusters of the vectors; the rows are written to the shared folder."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, spec, id_col, vector_col)
    id_type = rows.schema["id"].dataType.simpleString()
    centroids = first_centroids(rows, spec)
    if not centroids:
        return Clusters(spark.createDataFrame([], f"id {id_type}, cluster int, distance long"), [])
    simplex = Simplex(centroids, spec.pivots)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, spec.dims):
            apex = simplex.project(x)
            ends = np.arange(len(x) + 1, dtype=np.int32) * apex.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, apex.ravel())], [*batch.schema.names, "apex"])

    cached = written(rows.mapInArrow(project, f"id {id_type}, x array<long>, apex array<double>"), "apexes")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = simplex.project(np.array(centroids, dtype=np.float64))
        count, total = [0] * len(centroids), [[0] * spec.dims for _ in centroids]
        for batch, x in _blocks(batches, spec.dims):
            found, _ = nearest(x, _apexes(batch), centroids, centres)
            wide = x.astype(object) if max(int(x.max()), -int(x.min())) > SAFE else x
            for number in np.unique(found).tolist():
                own = wide[found == number]
                count[number] += len(own)
                total[number] = [a + int(b) for a, b in zip(total[number], own.sum(axis=0).tolist())]
        some = [(n, d) for n in range(len(centroids)) if count[n] for d in range(spec.dims)]
        if some:
            columns = [pa.array(list(c), pa.int32()) for c in zip(*some)]
            columns += [pa.array([count[n] for n, _ in some], pa.int64()), pa.array([str(total[n][d]) for n, d in some], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "dim", "n", "s"])

    for _ in range(spec.rounds):
        parts = cached.select("x", "apex").mapInArrow(sums, "cluster int, dim int, n long, s string")
        found = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        centroids = [list(c) for c in centroids]
        for r in found.collect():
            centroids[r.cluster][r.dim] = int(r.s) // r.n

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = simplex.project(np.array(centroids, dtype=np.float64))
        for batch, x in _blocks(batches, spec.dims):
            number, distance = nearest(x, _apexes(batch), centroids, centres)
            distance = np.minimum(distance, LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number), pa.array(distance)], ["id", "cluster", "distance"])

    return Clusters(written(cached.mapInArrow(assign, f"id {id_type}, cluster int, distance long"), "clusters"), centroids)


def report(found: Clusters, id_col: str = "vec_id") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of the components joined by commas)."""
    sums = found.inertia()
    whole = min(sum(s for _, s in sums), LARGEST)

    def of_cluster(values: list, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for (number, _), value in zip(sums, values):
            out = F.when(F.col("cluster") == number, F.lit(value).cast(kind)).otherwise(out)
        return out

    shas = [hashlib.sha256(",".join(map(str, found.centroids[n])).encode()).hexdigest() for n, _ in sums]
    return found.rows.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        of_cluster([min(s, LARGEST) for _, s in sums], "long").alias("cluster_inertia"),
        F.lit(whole).cast("long").alias("inertia"),
        of_cluster(shas, "string").alias("centroid_sha256"),
    )
