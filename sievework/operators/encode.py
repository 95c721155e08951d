"""Encoding of categories and binning of numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.exprs import numeric_columns, text_columns
from sievework.functions.order_stats import exact_quantiles, sampled_cuts, slice_of
from sievework.operators.schema import top_values
from sievework.session import parallelism

BROADCAST_LEVELS = 100_000


def _lookup_join(df: DataFrame, lookup: DataFrame, col: str, levels: int) -> DataFrame:
    """Left join of per-level values; broadcast only while the number of levels is small."""
    return df.join(F.broadcast(lookup) if levels <= BROADCAST_LEVELS else lookup, col, "left")


def label_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, index in sorted order).  Levels are ranked in slices of the sorted range."""
    levels = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    n = levels.count()
    if n <= BROADCAST_LEVELS:
        return levels.withColumn("code", F.row_number().over(Window.orderBy(col)) - 1)
    # Too many for one task: rank inside slices of the sorted range, then add the slice's offset.
    sized = levels.withColumn("_slice", slice_of(F.col(col), sampled_cuts(levels, col, n, parallelism(df))))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sized.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(col))
    return (
        sized.withColumn("_r", inside)
        .join(F.broadcast(offsets), "_slice")
        .select(col, (F.col("_r") - 1 + F.col("_off")).cast("int").alias("code"))
    )


def label_encode(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Index of the value among the sorted distinct values; NULL stays NULL."""
    lookup = label_dictionary(df, col)
    levels = lookup.count()
    out = _lookup_join(df, lookup.withColumnRenamed("code", "_code"), col, levels)
    target = name or col
    kept = [c for c in df.columns if c != target]
    return out.select(*kept, F.col("_code").alias(target))


def label_decode(df: DataFrame, dictionary: DataFrame, value: str, code: str) -> DataFrame:
    """Back from codes to values; ``dictionary`` is the one the encoder used."""
    back = dictionary.select(F.col("code").alias(code), F.col(value).alias(f"{value}_decoded"))
    return _lookup_join(df, back, code, dictionary.count())


def levels_of(df: DataFrame, col: str, limit: int | None = 50) -> list:
    """Sorted distinct non-null values, refused beyond ``limit``; at most limit + 1 are read.

    None lifts the limit: the caller wants a column per value.
    """
    levels = df.where(F.col(col).isNotNull()).select(col).distinct()
    got = [r[0] for r in (levels if limit is None else levels.limit(limit + 1)).collect()]
    if limit is not None and len(got) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values")
    return sorted(got)


def one_hot(df: DataFrame, col: str, drop_first: bool = True, limit: int | None = 50) -> DataFrame:
    """0/1 columns ``{col}_{value}`` in place of the column."""
    levels = levels_of(df, col, limit)
    made = [
        F.coalesce(F.col(col) == F.lit(v), F.lit(False)).cast("int").alias(f"{col}_{v}")
        for v in (levels[1:] if drop_first else levels)
    ]
    return df.select(*[c for c in df.columns if c != col], *made)


def one_hot_stage(df: DataFrame, cols: Sequence[str], limit: int = 50) -> tuple[SQLTransformer | None, list[str]]:
    """A saveable stage that adds 0/1 columns, first level dropped, unknown levels all zero."""
    parts, names = [], []
    for c in cols:
        for i, v in enumerate(levels_of(df, c, limit)[1:], 1):
            text = str(v).replace("\\", "\\\\").replace("'", "\\'")
            names.append(f"{c}_is_{i}")
            parts.append(f"CAST(COALESCE(CAST(`{c}` AS STRING) = '{text}', false) AS DOUBLE) AS `{c}_is_{i}`")
    if not parts:
        return None, []
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"), names


def equal_width_bins(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Right-closed bins of equal width with labels 0..k-1 in ``{col}_binned``."""
    row = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    x = F.col(col).cast("double")
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return df.withColumn(f"{col}_binned", F.lit(None).cast("int"))
    if lo == hi:
        # The range is widened to both sides of the single value: it falls into the middle bin.
        return df.withColumn(f"{col}_binned", F.when(x.isNotNull(), (k - 1) // 2))
    width = (hi - lo) / k
    edges = [lo + width * i for i in range(1, k)]
    return df.withColumn(f"{col}_binned", F.when(x.isNotNull(), right_closed_bin(x, edges)))


def right_closed_bin(x: Column, inner_edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """Index (or label) of the first inner edge >= x, else the last bin."""
    labels = list(labels if labels is not None else range(len(inner_edges) + 1))
    out = None
    for e, label in zip(inner_edges, labels):
        out = F.when(x <= F.lit(float(e)), label) if out is None else out.when(x <= F.lit(float(e)), label)
    return F.lit(labels[-1]) if out is None else out.otherwise(labels[-1])


def quantile_bins(df: DataFrame, col: str, k: int = 5, labels: Sequence | None = None, name: str | None = None) -> DataFrame:
    """Bins with equal shares of the rows; equal edges are an error."""
    return quantile_bins_many(df, {col: labels}, k, {col: name or f"{col}_bin"})


def quantile_bins_many(
    df: DataFrame, labels: Mapping[str, Sequence | None], k: int, names: Mapping[str, str]
) -> DataFrame:
    cols = list(labels)
    edges = exact_quantiles(df, cols, [i / k for i in range(k + 1)])
    new = {}
    for c in cols:
        e = edges[c]
        if e[0] is not None and len(set(e)) < len(e):
            raise ValueError(f"{c}: quantile edges are not distinct: {e}")
        x = F.col(c).cast("double")
        inner = e[1:-1] if e[0] is not None else []
        new[names[c]] = F.when(x.isNotNull(), right_closed_bin(x, inner, labels[c]))
    return df.withColumns(new)


def custom_bins(df: DataFrame, col: str, edges: Sequence[float], name: str) -> DataFrame:
    """Left-closed bins between the given edges, the last one closed; NULL outside."""
    x = F.col(col).cast("double")
    label = F.lit(0)
    for e in edges[1:-1]:
        label = label + (x >= F.lit(float(e))).cast("int")
    return df.withColumn(name, F.when(x.between(float(edges[0]), float(edges[-1])), label))


def group_small_categories(df: DataFrame, max_levels: int = 10, cols: Sequence[str] | None = None, keep: int | None = None) -> DataFrame:
    """Keep the most frequent levels of wide text columns; the rest and NULL become 'Other'."""
    cols = list(cols or text_columns(df))
    keep = max_levels if keep is None else keep
    for c in cols:
        top = [r[0] for r in top_values(df, c, max_levels + 1).collect()]
        if len(top) > max_levels:
            df = df.withColumn(c, F.when(F.col(c).isin(top[:keep]), F.col(c)).otherwise("Other"))
    return df


def mean_target_encode(df: DataFrame, col: str, target: str | None = None) -> DataFrame:
    """``{col}_encoded``: mean of the target (default: first numeric column) per level."""
    target = target or numeric_columns(df)[0]
    levels = df.agg(F.approx_count_distinct(col)).first()[0]
    means = df.groupBy(col).agg(F.avg(target).alias(f"{col}_encoded"))
    return _lookup_join(df, means, col, levels)


def smoothed_target_encode(
    df: DataFrame, col: str, target: str, min_leaf: float = 20.0, smoothing: float = 10.0
) -> DataFrame:
    """Level mean blended with the overall mean by a logistic weight of the level's size."""
    prior = df.agg(F.avg(target)).first()[0]
    levels = df.agg(F.approx_count_distinct(col)).first()[0]
    n, mean = F.count(target), F.avg(target)
    w = 1 / (1 + F.exp(-(n - F.lit(min_leaf)) / F.lit(smoothing)))
    per_level = df.groupBy(col).agg((F.lit(prior) * (1 - w) + mean * w).alias("_enc"))
    out = _lookup_join(df, per_level, col, levels)
    return out.select(*df.columns, F.coalesce("_enc", F.lit(prior)).alias(f"{col}_encoded"))


def ordinal_encode(df: DataFrame, col: str, ordered: Sequence, name: str) -> DataFrame:
    out = F.when(F.col(col) == F.lit(ordered[0]), 0)
    for i, v in enumerate(ordered[1:], 1):
        out = out.when(F.col(col) == F.lit(v), i)
    return df.withColumn(name, out)
