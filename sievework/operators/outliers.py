"""Outlier removal and flags."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import numeric_columns
from sievework.functions.order_stats import exact_quantiles, value_at_ranks
from sievework.operators.missing import fill_mean
from sievework.session import cut_lineage


def zscore_limits(df: DataFrame, cols: Sequence[str], limit: float = 3.0) -> list[tuple[str, float, float]]:
    """(column, mean, std) per step; each step sees only the rows the steps before have kept."""
    steps = []
    for c in cols:
        row = df.agg(F.avg(c).alias("a"), F.stddev_samp(c).alias("s")).first()
        steps.append((c, row["a"], row["s"]))
        df = df.where(_within(c, row["a"], row["s"], limit))
    return steps


def _within(col: str, mean: float | None, std: float | None, limit: float):
    if not std:
        return F.lit(True)
    return F.coalesce(F.abs((F.col(col) - F.lit(mean)) / F.lit(std)) <= limit, F.lit(True))


def remove_zscore_outliers(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 3.0) -> DataFrame:
    """Drop rows beyond ``limit`` standard deviations, one column after the other."""
    for c, mean, std in zscore_limits(df, list(cols or numeric_columns(df)), limit):
        df = df.where(_within(c, mean, std, limit))
    return df


def iqr_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR per column: count, percentage, extremes."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.75])
    aggs, rows = [F.count(F.lit(1)).alias("n_rows")], []
    for i, c in enumerate(cols):
        q1, q3 = quartiles[c]
        if q1 is None:
            continue
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        out = (F.col(c) < lo) | (F.col(c) > hi)
        v = F.when(out, F.col(c).cast("double"))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("n_outliers"),
                (F.col(f"n{i}") * 100.0 / F.col("n_rows")).alias("pct_outliers"),
                F.col(f"lo{i}").alias("min_outlier"),
                F.col(f"hi{i}").alias("max_outlier"),
            )
        )
    if not rows:  # no column holds a value
        kind = "column string, n_outliers bigint, pct_outliers double, min_outlier double, max_outlier double"
        return df.sparkSession.createDataFrame([], kind)
    return df.agg(*aggs).select(F.inline(F.array(*rows))).where("n_outliers > 0")


def winsorise(df: DataFrame, cols: Sequence[str], share: float = 0.05) -> DataFrame:
    """Clamp to the (k+1)-th smallest and largest value, k = floor(share * n)."""
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    new = {}
    for i, c in enumerate(cols):
        n = counts[f"n{i}"]
        if not n:
            continue
        k = math.floor(share * n)
        at = value_at_ranks(df, c, sorted({k, n - 1 - k}))
        v = F.col(c).cast("double")
        new[c] = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(at[k])), F.lit(at[n - 1 - k])))
    return df.withColumns(new)


# --- isolation forest ---------------------------------------------------------------------


def _average_path(n):
    """Mean path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth + expected rest); feature -1 is a leaf."""
    nodes: list[tuple] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(())
        spread = rows.max(axis=0) - rows.min(axis=0)
        usable = np.flatnonzero(spread > 0)
        if depth >= max_depth or len(rows) <= 1 or len(usable) == 0:
            nodes[at] = (-1, 0.0, -1, -1, depth + float(_average_path(len(rows))))
            return at
        f = int(rng.choice(usable))
        t = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] < t
        lo, hi = add(rows[left], depth + 1), add(rows[~left], depth + 1)
        nodes[at] = (f, t, lo, hi, 0.0)
        return at

    add(x, 0)
    return nodes


class IsolationForest:
    """Trees from small random samples; a tree is grown in the task that holds its sample."""

    def __init__(self, cols: Sequence[str], trees: int = 100, sample_size: int = 256, seed: int = 42):
        self.cols, self.n_trees, self.sample_size, self.seed = list(cols), trees, sample_size, seed
        self.trees: list[np.ndarray] = []
        self.norm = 1.0

    def fit(self, df: DataFrame) -> IsolationForest:
        n = df.count()
        size = min(self.sample_size, n)
        # Sampling operator: about 1.5 samples' worth of rows, each given to one tree.
        fraction = min(1.0, 1.5 * self.n_trees * size / max(1, n))
        copies = 1 if fraction < 1.0 else math.ceil(1.5 * self.n_trees * size / max(1, n))
        x = df.select(*[F.col(c).cast("double").alias(c) for c in self.cols])
        picked = x.sample(fraction=fraction, seed=self.seed) if fraction < 1.0 else x
        if copies > 1:
            picked = picked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        picked = picked.withColumn("_tree", F.floor(F.rand(self.seed) * self.n_trees).cast("int"))
        cols, seed, depth = self.cols, self.seed, math.ceil(math.log2(max(size, 2)))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["_tree"].iloc[0])
            rng = np.random.default_rng(seed + tree)
            rows = pdf[cols].to_numpy()
            rows = rows[rng.permutation(len(rows))[:size]]
            return pd.DataFrame(
                [(tree, i, *node) for i, node in enumerate(_grow(rows, rng, depth))],
                columns=["tree", "node", "feature", "threshold", "lo", "hi", "path"],
            )

        schema = "tree int, node int, feature int, threshold double, lo int, hi int, path double"
        nodes = picked.groupBy("_tree").applyInPandas(grow, schema).toPandas()
        self.trees = [
            t.sort_values("node")[["feature", "threshold", "lo", "hi", "path"]].to_numpy()
            for _, t in nodes.groupby("tree")
        ]
        self.norm = float(_average_path(size)) or 1.0
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Anomaly score in (0, 1); the trees (at most a few thousand nodes) travel with the task."""
        trees, norm = self.trees, self.norm

        @F.pandas_udf("double")
        def anomaly(*parts: pd.Series) -> pd.Series:
            x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
            total = np.zeros(len(x))
            for t in trees:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = t[at, 0].astype(int)
                    live = np.flatnonzero(f >= 0)
                    if len(live) == 0:
                        break
                    go_left = x[live, f[live]] < t[at[live], 1]
                    at[live] = np.where(go_left, t[at[live], 2], t[at[live], 3]).astype(int)
                total += t[at, 4]
            return pd.Series(np.power(2.0, -total / len(trees) / norm))

        return df.withColumn(name, anomaly(*[F.col(c).cast("double") for c in self.cols]))


def flag_isolated(df: DataFrame, cols: Sequence[str], contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``is_outlier`` for the given share of most isolated rows; NULLs count as the mean."""
    filled = fill_mean(df.withColumns({f"_x_{c}": F.col(c).cast("double") for c in cols}), [f"_x_{c}" for c in cols])
    forest = IsolationForest([f"_x_{c}" for c in cols], seed=seed).fit(filled)
    scored = forest.score(filled, "_score")
    # The threshold needs several passes over the scores: keep them once, 8 bytes per row.
    scores = cut_lineage(scored.select("_score"))
    cut = exact_quantiles(scores, ["_score"], [1.0 - contamination])["_score"][0]
    return scored.withColumn("is_outlier", F.col("_score") > cut).select(*df.columns, "is_outlier")
