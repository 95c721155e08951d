"""Nearest neighbours by multi-index hashing.

Vectors are centred, turned by learned rotations (iterative quantisation on a bounded sample) and
cut to signs: ``tables`` rotations give ``tables`` * dims bits. A code is split into substrings of
16 bits, each of which has an index of its own. Two codes within Hamming radius R agree on at least
one of m substrings within R // m bits (pigeonhole), so looking up those entries in every index
finds every code within R. What is found is checked on the whole code and ranked again on the
original vectors in double precision.

R comes from the sample: the ``quantile`` of the distances between the codes of true neighbours
there. In the whole table neighbours are closer than in a sample of it. A query with fewer than k
results within R is searched once more without a radius, so it gets all it can.

The index is cut by hash into blocks of about ``block_rows`` codes and the queries into chunks; every
block meets every chunk in a group of bounded size, which returns the best k only. Vectors that are
equal share one entry with their k + 1 smallest ids; no other copy can be among k results.

Vectors that are null, empty, zero or hold a null or non-finite component take no part. Vectors of
one length are an index of their own: a query meets the vectors of its length. Rows of one id are
searched one by one; an id that is a query is not its own result. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import partitions, written
from sievework.llm.textbatch import gather


@dataclass(frozen=True)
class IndexSpec:
    """``sample``: vectors that the rotations and the radius are learned from."""

    tables: int = 4
    sample: int = 8000
    quantile: float = 0.99
    rounds: int = 20
    block_rows: int = 16_384
    chunk_queries: int = 4096


@dataclass
class Codes:
    mean: np.ndarray
    rotations: list[np.ndarray]
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors to rows of 16-bit substrings."""
        y = x - self.mean
        bits = np.concatenate([(y @ r) > 0 for r in self.rotations], axis=1)
        pad = -bits.shape[1] % 16
        if pad:
            bits = np.concatenate([bits, np.zeros((len(bits), pad), dtype=bool)], axis=1)
        return np.packbits(bits, axis=1).view(np.uint16)


def _rotation(y: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Iterative quantisation: alternate between signs and the best rotation onto them."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(y.shape[1], y.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(y.T @ np.sign(y @ r))
        r = u @ v
    return r


def fit(vectors: DataFrame, k: int, spec: IndexSpec) -> Codes:
    """``vectors`` has id and unit (a unit vector); the sample is that of the smallest hashes of the ids."""
    rows = vectors.orderBy(F.xxhash64(F.lit("hamming"), "id"), "id").limit(spec.sample).select("unit").toArrow()
    x = np.array(rows.column("unit").to_pylist(), dtype=np.float64)
    mean = x.mean(axis=0)
    y = x - mean
    codes = Codes(mean, [_rotation(y, spec.rounds, s) for s in range(spec.tables)], 0)
    code = codes.encode(x)
    bits = np.unpackbits(code.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    ask = np.arange(0, len(x), max(1, len(x) // 500))
    near = x[ask] @ x.T
    near[np.arange(len(ask)), ask] = -2
    k = min(k, len(x) - 1)
    if k < 1:
        return codes
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    apart = (bits.shape[1] - (bits[ask] @ bits.T)) / 2
    codes.radius = int(np.quantile(np.take_along_axis(apart, best, axis=1), spec.quantile))
    return codes


def usable(vectors: DataFrame, asked: Column, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (doubles), asked, unit: the vectors that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), asked.alias("asked"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0))
    # Scaled by the largest component first, so that no square over- or underflows.
    top = F.array_max(F.transform(v, F.abs))
    rows = rows.withColumn("unit", F.transform(v, lambda x: x / top))
    length = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("unit", F.transform("unit", lambda x: x / length))


_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


class SubstringIndex:
    """For each substring the values that occur and the rows that hold each of them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, first, size = np.unique(codes[order, j], return_index=True, return_counts=True)
            self.tables.append((values, first, size, order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        m = len(code)
        found = np.zeros(len(self.codes), dtype=bool)
        for (values, first, size, order), own in zip(self.tables, code):
            hit = np.flatnonzero(_POPCOUNT[values ^ own] <= radius // m)
            found[gather(order, first[hit], size[hit])] = True
        rows = np.flatnonzero(found)
        return rows[_POPCOUNT[self.codes[rows] ^ code].sum(axis=1) <= radius]


def _search(index: pd.DataFrame, asked: pd.DataFrame, codes: Codes, radius: int, k: int) -> pd.DataFrame:
    """The best k (query, id) of one block for the queries of one chunk."""
    code = np.stack([np.frombuffer(c, dtype=np.uint16) for c in index["code"]])
    unit = np.stack(index["unit"].to_numpy())
    ids = [np.asarray(x) for x in index["ids"]]
    tables = SubstringIndex(code)
    everything = radius >= 16 * code.shape[1]
    out = []
    for number, query, own_code, own in zip(asked["number"], asked["query"], asked["code"], asked["unit"]):
        rows = np.arange(len(code)) if everything else tables.within(np.frombuffer(own_code, dtype=np.uint16), radius)
        if len(rows) == 0:
            continue
        score = (unit[rows] * np.asarray(own)).sum(axis=1)
        # All rows at least as near as the (k + 1)-th: the query itself may be among them.
        if len(rows) > k + 1:
            edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            rows, score = rows[score >= edge], score[score >= edge]
        pairs = [(-s, i) for s, r in zip(score.tolist(), rows.tolist()) for i in ids[r].tolist() if i != query]
        out += [(number, query, i, -s) for s, i in sorted(pairs)[:k]]
    return pd.DataFrame(out, columns=["number", "query", "id", "score"])


def search(vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", spec: IndexSpec = IndexSpec()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine for each row where ``asked`` holds."""
    rows = written(usable(vectors, asked, id_col, vector_col), "vectors")
    counts = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("total"), F.count_if("asked").alias("queries"))
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sorted(counts.filter("queries > 0").collect()):
        found = found.unionAll(_search_length(rows.filter(F.size("vector") == r.n), r.total, k, spec))
    return found


def _search_length(rows: DataFrame, total: int, k: int, spec: IndexSpec) -> DataFrame:
    """The results among ``total`` vectors of one length."""
    codes = fit(rows, k, spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = np.stack(batch.column("unit").to_numpy(zero_copy_only=False))
                code = pa.array([c.tobytes() for c in codes.encode(unit)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, code], [*batch.schema.names, "code"])

    def encoded(df: DataFrame) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(encode, f"{schema}, code binary")

    # Copies: of each vector the k + 1 smallest distinct ids; the limit also works before the shuffle.
    same = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("vector"), F.col("vector")).alias("h2")]
    copies = rows.select(*same, "id", "unit").dropDuplicates(["h1", "h2", "id"]).withColumn("at", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id")))
    entries = copies.filter(F.col("at") <= k + 1).groupBy("h1", "h2").agg(
        F.first("unit").alias("unit"), F.array_sort(F.collect_list("id")).alias("ids")
    )
    entries = written(encoded(entries.select("unit", "ids")), "index")
    queries = rows.filter("asked").withColumn("number", F.monotonically_increasing_id())
    queries = written(encoded(queries.select("number", F.col("id").alias("query"), "unit")), "queries")

    def best(queries: DataFrame, radius: int) -> DataFrame:
        blocks = max(partitions(rows), -(-total // spec.block_rows))
        chunks = max(1, -(-queries.count() // spec.chunk_queries))
        left = entries.withColumn("block", F.pmod(F.xxhash64("code", "ids"), F.lit(blocks)).cast("int")).withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
        )
        right = queries.withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )

        def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if len(index) == 0 or len(asked) == 0:
                return pd.DataFrame({"number": pd.Series(dtype="int64"), "query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
            return _search(index, asked, codes, radius, k)

        found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(
            run, "number long, query long, id long, score double"
        )
        order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id")))  # k rows from each block
        top = found.groupBy("number", "query").agg(F.slice(order, 1, k).alias("top"))
        return written(top, "found")

    first = best(queries, codes.radius)
    enough = first.filter(F.size("top") >= k)
    short = written(queries.join(enough, "number", "left_anti"), "short")
    if not short.isEmpty():
        enough = enough.unionAll(best(short, 1 << 30))
    return enough.select("query", F.posexplode("top").alias("at", "x")).select(
        F.col("query").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )
