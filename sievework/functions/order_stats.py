"""Exact quantiles, ranks and positions without gathering a group into one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer.
That is the best plan while the number of distinct values is small, so each entry point
measures it first (one cheap scan).  Beyond ``DISTINCT_LIMIT``:

* global quantiles narrow a bracket around the wanted rank with bounded sketches and exact
  counts, which needs a few scans and no shuffle of the data;
* grouped quantiles cut the value range into slices, count distinct values per slice, and
  place every value by the slice's offset plus its rank inside the slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import parallelism

DISTINCT_LIMIT = 1_000_000
BRACKET_LIMIT = 100_000
SKETCH_ACCURACY = 10_000
MAX_CUTS = 256


def slice_of(value: Column, cuts: Sequence) -> Column:
    """How many of the sorted ``cuts`` are <= value, as a balanced CASE expression."""

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(cuts))


def value_slices(df: DataFrame, value: Column, slices: int) -> tuple[Column, list[float]]:
    """A slice number that grows with ``value``, and the values that fill a slice alone.

    At most ``MAX_CUTS`` cut points come from a bounded sketch; more slices than that are made
    by dividing each slice evenly.  A value so frequent that it spans slices gets one of its
    own: one cut at the value and one just above it.
    """
    base = min(MAX_CUTS, slices)
    fine = math.ceil(slices / base)
    probs = [i / base for i in range(base + 1)]
    got = df.agg(F.percentile_approx(value.cast("double"), probs, SKETCH_ACCURACY).alias("c")).first()["c"]
    if not got:
        return F.lit(0).cast("bigint"), []
    inner = got[1:-1]
    hot = sorted({v for v, w in zip(inner, inner[1:]) if v == w})
    cuts = sorted(set(inner) | {math.nextafter(v, math.inf) for v in hot})
    first = slice_of(value, cuts).cast("bigint")
    if fine == 1:
        return first, hot
    edges = [got[0], *cuts, got[-1]]
    at = (first + 1).cast("int")
    low = F.element_at(F.array(*[F.lit(e) for e in edges[:-1]]), at)
    high = F.element_at(F.array(*[F.lit(e) for e in edges[1:]]), at)
    share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    part = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor(share * fine)))
    return first * fine + part, hot


def sampled_cuts(distinct: DataFrame, col: str, n_rows: int, slices: int) -> list:
    """Cut points from a bounded sample of distinct values of any sortable type.

    The sample only steers how even the slices are, never which rows are in the result.
    """
    slices = min(slices, MAX_CUTS)
    wanted = 50 * slices
    part = distinct.select(col).sample(fraction=min(1.0, wanted / max(n_rows, 1)), seed=7)
    got = sorted(r[0] for r in part.limit(2 * wanted).collect())
    return sorted({got[i * len(got) // slices] for i in range(1, slices)}) if got else []


def _ranks_for(n: int, probs: Iterable[float]) -> list[int]:
    out = set()
    for p in probs:
        h = p * (n - 1)
        out |= {math.floor(h), math.ceil(h)}
    return sorted(out)


def _interpolate(at: dict[int, float], n: int, p: float) -> float:
    h = p * (n - 1)
    lo, hi = math.floor(h), math.ceil(h)
    return at[lo] + (at[hi] - at[lo]) * (h - lo)


def _column_sizes(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, int]]:
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"d{i}"]) for i, c in enumerate(cols)}


def _inside(col: str, low: float | None, high: float | None) -> Column:
    """Non-null values strictly between two known values."""
    v = F.col(col).cast("double")
    cond = v.isNotNull()
    if low is not None:
        cond = cond & (v > F.lit(low))
    if high is not None:
        cond = cond & (v < F.lit(high))
    return cond


def _narrow(df: DataFrame, targets: Sequence[tuple[str, int, int]]) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks, for ``(column, rank, non-null count)`` targets.

    Each round is two scans for all targets together: bounded sketches propose a bracket
    around every rank, exact counts say on which side of it the rank lies.  Ranks in the same
    open interval share one sketch.  An interval with few distinct values is counted out.
    """
    step = 2.0 / SKETCH_ACCURACY
    found: dict[tuple[str, int], float] = {}
    # (column, low, high) -> (rows up to low, rows inside, ranks looked for)
    open_: dict[tuple, tuple[int, int, list[int]]] = {}
    for c, r, n in targets:
        open_.setdefault((c, None, None), (0, n, []))[2].append(r)
    ready: dict[tuple, tuple[int, list[int]]] = {}
    while open_:
        groups = list(open_.items())
        sketches, asked = [], []
        for i, ((c, low, high), (below, size, ranks)) in enumerate(groups):
            at = {r: (r - below) / max(size - 1, 1) for r in ranks}
            probs = sorted({q for p in at.values() for q in (max(0.0, p - step), min(1.0, p + step))})
            v = F.when(_inside(c, low, high), F.col(c).cast("double"))
            sketches.append(F.percentile_approx(v, probs, SKETCH_ACCURACY).alias(f"q{i}"))
            asked.append((at, probs))
        got = df.agg(*sketches).first()
        brackets: dict[tuple, list[int]] = {}
        for i, ((c, low, high), (below, size, ranks)) in enumerate(groups):
            at, probs = asked[i]
            value = dict(zip(probs, got[f"q{i}"]))
            for r in ranks:
                lo, hi = value[max(0.0, at[r] - step)], value[min(1.0, at[r] + step)]
                brackets.setdefault((c, low, high, below, size, lo, hi), []).append(r)
        counts = []
        for i, (c, low, high, _, _, lo, hi) in enumerate(brackets):
            inside, v = _inside(c, low, high), F.col(c).cast("double")
            counts += [
                F.count_if(inside & (v < lo)).alias(f"lt_lo{i}"),
                F.count_if(inside & (v <= lo)).alias(f"le_lo{i}"),
                F.count_if(inside & (v < hi)).alias(f"lt_hi{i}"),
                F.count_if(inside & (v <= hi)).alias(f"le_hi{i}"),
                F.approx_count_distinct(F.when(inside & (v > lo) & (v < hi), v)).alias(f"d{i}"),
            ]
        row = df.agg(*counts).first()
        open_ = {}
        for i, ((c, low, high, below, size, lo, hi), ranks) in enumerate(brackets.items()):
            lt_lo, le_lo, lt_hi, le_hi = (row[f"{k}{i}"] for k in ("lt_lo", "le_lo", "lt_hi", "le_hi"))
            for r in ranks:
                k = r - below
                if lt_lo <= k < le_lo:
                    found[c, r] = lo
                elif lt_hi <= k < le_hi:
                    found[c, r] = hi
                elif k < lt_lo:
                    open_.setdefault((c, low, lo), (below, lt_lo, []))[2].append(r)
                elif k >= le_hi:
                    open_.setdefault((c, hi, high), (below + le_hi, size - le_hi, []))[2].append(r)
                elif row[f"d{i}"] <= BRACKET_LIMIT:
                    ready.setdefault((c, lo, hi), (below + le_lo, []))[1].append(r)
                else:
                    open_.setdefault((c, lo, hi), (below + le_lo, lt_hi - le_lo, []))[2].append(r)
    for (c, lo, hi), (below, ranks) in ready.items():
        v = F.col(c).cast("double").alias("v")
        cells = df.where(_inside(c, lo, hi)).groupBy(v).count().orderBy("v").collect()
        for r in ranks:
            left = r - below
            for cell in cells:
                if left < cell["count"]:
                    found[c, r] = cell["v"]
                    break
                left -= cell["count"]
    return found


def value_at_ranks(df: DataFrame, col: str, ranks: Sequence[int]) -> dict[int, float]:
    """Exact values at 0-based ranks of one column."""
    n, distinct = _column_sizes(df, [col])[col]
    if distinct > DISTINCT_LIMIT:
        found = _narrow(df, [(col, r, n) for r in ranks])
        return {r: found[col, r] for r in ranks}
    # (r + .5)/n picks rank r exactly under the "first value whose share reaches p" rule.
    parts = [
        F.expr(f"percentile_disc({(r + 0.5) / n!r}D) WITHIN GROUP (ORDER BY CAST(`{col}` AS DOUBLE))").alias(f"r{r}")
        for r in ranks
    ]
    row = df.agg(*parts).first()
    return {r: row[f"r{r}"] for r in ranks}


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of whole columns; NULLs are skipped."""
    sizes = _column_sizes(df, cols)
    small, budget = [], DISTINCT_LIMIT
    for c in sorted(cols, key=lambda c: sizes[c][1]):
        if sizes[c][1] <= budget:
            small.append(c)
            budget -= sizes[c][1]
    out: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(
            *[F.percentile(F.col(c).cast("double"), list(probs)).alias(f"q{i}") for i, c in enumerate(small)]
        ).first()
        for i, c in enumerate(small):
            out[c] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
    large = [c for c in cols if c not in out]
    if large:
        found = _narrow(df, [(c, r, sizes[c][0]) for c in large for r in _ranks_for(sizes[c][0], probs)])
        for c in large:
            at = {r: v for (name, r), v in found.items() if name == c}
            out[c] = [_interpolate(at, sizes[c][0], p) for p in probs]
    return out


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """One row per key with the named linearly interpolated quantiles of ``value``."""
    distinct = df.agg(F.approx_count_distinct(value)).first()[0]
    if distinct <= DISTINCT_LIMIT:
        q = df.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), list(probs)).alias("_q"))
        return q.select(*keys, *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
    v = F.col(value).cast("double")
    place, _ = value_slices(df.select(v.alias("_v")), F.col("_v"), parallelism(df))
    counts = (
        df.where(v.isNotNull())
        .groupBy(*keys, v.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_s", place)
    )
    per_slice = counts.groupBy(*keys, "_s").agg(F.sum("_c").alias("_sc"))
    by_key = Window.partitionBy(*keys)
    offsets = per_slice.withColumn(
        "_off",
        F.coalesce(
            F.sum("_sc").over(by_key.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).withColumn("_n", F.sum("_sc").over(by_key))
    o = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_s").alias("_s2"), "_off", "_n")
    on = F.col("_s") == F.col("_s2")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(o, on).withColumn(
        "_start", F.col("_off") + F.coalesce(F.sum("_c").over(inner), F.lit(0))
    )
    picks = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        for tag, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("_start") <= r) & (r < F.col("_start") + F.col("_c"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
    got = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for i, (p, nm) in enumerate(zip(probs, names)):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(nm))
    return got.select(*keys, *out)
