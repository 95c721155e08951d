"""Joins, unions and windows the other operators share, as callable operators.

A small side is broadcast only after its size is known; otherwise Spark joins by shuffle and
splits skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.scans import Run, scan_series
from sievework.operators.timeseries import exponential_mean, long_series, with_moving_mean
from sievework.session import union_rows

BROADCAST_ROWS = 1_000_000


def small(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast if it has at most ``limit`` rows (at most limit + 1 are counted)."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def lookup(df: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Left lookup of one value per key."""
    return df.join(small(words), key, "left")


def keep_members(df: DataFrame, values: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """Rows whose key is (not) among the values; a NULL key is never a member."""
    return df.join(small(values.select(key).distinct()), key, "left_anti" if negate else "left_semi")


def with_scalar(df: DataFrame, source: DataFrame, value: Column, name: str) -> DataFrame:
    """Attach one aggregate of ``source`` to every row as a scalar subquery."""
    return df.withColumn(name, source.agg(value).scalar())


def union_kinds(parts: dict[str, DataFrame]) -> DataFrame:
    """Row union by name with a ``kind`` column."""
    return union_rows(part.withColumn("kind", F.lit(kind)) for kind, part in parts.items())


def top_rows(df: DataFrame, by: str, n: int, key: str, ascending: bool = False) -> DataFrame:
    """First n rows of an order made unique by the key; per-task top n, then one merge."""
    return df.orderBy(F.asc(by) if ascending else F.desc(by), key).limit(n)


def rolling_mean(df: DataFrame, keys: Sequence[str], rows: int, name: str = "rolling") -> DataFrame:
    """Mean of the last ``rows`` points of a (keys, ts, value) series, NULL until there are enough."""
    return with_moving_mean(df, keys, rows, name)


def lag_difference(df: DataFrame, keys: Sequence[str], name: str = "diff") -> DataFrame:
    """Value less the value before it in its series."""
    if long_series(df, keys):

        def less_previous(run: Run) -> dict[str, np.ndarray]:
            before = run.left[-1:] if len(run.left) else np.array([np.nan])
            return {name: run.values - np.concatenate([before, run.values[:-1]])}

        return scan_series(df, keys, "ts", "value", {name: "double"}, less_previous, before=1)
    w = Window.partitionBy(*keys).orderBy("ts")
    return df.withColumn(name, F.col("value") - F.lag("value").over(w))


def smoothed(df: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    return exponential_mean(df, keys, alpha).withColumnRenamed("fitted", "smoothed")
