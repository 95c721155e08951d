"""Missing values: reports and fills."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import numeric_columns, per_column
from sievework.functions.order_stats import exact_quantiles
from sievework.functions.ordered import with_known_neighbours
from sievework.session import cut_lineage, union_rows


def fill_values(df: DataFrame, cols: Sequence[str], strategy: str) -> dict[str, float]:
    """The learned fill value per numeric column: 'mean' or 'median'."""
    if not cols:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
        found = {c: row[f"v{i}"] for i, c in enumerate(cols)}
    elif strategy == "median":
        found = {c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}
    else:
        raise ValueError(strategy)
    return {c: v for c, v in found.items() if v is not None}


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def fill_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return apply_fill(df, fill_values(df, cols, "mean"))


def fill_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return apply_fill(df, fill_values(df, cols, "median"))


def mode_value(df: DataFrame, col: str):
    """Most frequent value, the smallest one on ties; counted in a shuffle, not in one buffer."""
    top = (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), col)
        .first()
    )
    return None if top is None else top[col]


def fill_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    found = {c: mode_value(df, c) for c in cols}
    return apply_fill(df, {c: v for c, v in found.items() if v is not None})


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0.0, list(cols))


def fill_forward_backward(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, value: str
) -> DataFrame:
    """Last known value in date order, else the next known one; error if a series has none."""
    near = with_known_neighbours(df, keys, order, tie, value)
    none_known = F.raise_error(F.lit(f"{value}: a series has no known value")).cast(dict(df.dtypes)[value])
    return near.select(
        *[c for c in df.columns if c != value],
        F.coalesce(F.col("_prev"), F.col("_next"), none_known).alias(value),
    )


def fill_linear(df: DataFrame, keys: Sequence[str], order: str, tie: str, value: str) -> DataFrame:
    """Straight line between neighbours by position; leading gaps stay, trailing ones repeat."""
    near = with_known_neighbours(df, keys, order, tie, value)
    share = (F.col("_pos") - F.col("_prev_pos")) / (F.col("_next_pos") - F.col("_prev_pos"))
    line = F.col("_prev") + (F.col("_next") - F.col("_prev")) * share
    filled = F.coalesce(
        F.col(value),
        F.when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(), line),
        F.col("_prev"),
    )
    return near.select(*[c for c in df.columns if c != value], filled.alias(value))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percentage, most first."""
    prof = per_column(
        df,
        df.columns,
        {
            "n_missing": lambda c: F.count_if(F.col(f"`{c}`").isNull()),
            "pct_missing": lambda c: F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100,
        },
    )
    return prof.where("n_missing > 0").orderBy(F.desc("n_missing"), "column")


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table, and their share of all cells in percent."""
    width = len(df.columns)
    total = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    return df.agg(
        total.cast("bigint").alias("missing_cells"),
        (F.count(F.lit(1)) * width).alias("total_cells"),
        F.try_divide(total * 100.0, F.count(F.lit(1)) * width).alias("pct_missing"),
    )


def _moments(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sum of outer products of (1, columns): one scan, a (d+1) x (d+1) matrix."""
    d = len(cols)
    terms = [F.lit(1.0), *[F.col(c) for c in cols]]
    aggs = [F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
    row = df.agg(*aggs).first()
    m = np.zeros((d + 1, d + 1))
    for i in range(d + 1):
        for j in range(i, d + 1):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    return m


def fill_iterative(
    df: DataFrame, cols: Sequence[str], rounds: int = 10, ridge: float = 1e-6, tolerance: float = 1e-3
) -> DataFrame:
    """Round-robin linear regression of each column with gaps on all the others.

    The normal equations need only second moments.  Those of complete rows never change and
    are summed once; each round rescans only the rows with gaps, which are written to the
    checkpoint folder so that lineage does not grow.  Columns are centred and scaled first so
    that the ridge term means the same for each.
    """
    cols = list(cols)
    stats = df.agg(
        *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(cols)],
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
    ).first()
    mean = {c: stats[f"a{i}"] or 0.0 for i, c in enumerate(cols)}
    scale = {c: stats[f"d{i}"] or 1.0 for i, c in enumerate(cols)}
    gaps = sorted((c for i, c in enumerate(cols) if stats[f"n{i}"]), key=lambda c: stats[f"n{cols.index(c)}"])
    if not gaps:
        return df
    any_gap = F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) == 1
    z = {c: (F.col(c) - F.lit(mean[c])) / F.lit(scale[c]) for c in cols}
    fixed = _moments(df.where(~any_gap).select(*[z[c].alias(c) for c in cols]), cols)
    work = df.where(any_gap).withColumns(
        {**{f"_m_{c}": F.col(c).isNull() for c in gaps}, **{c: F.coalesce(z[c], F.lit(0.0)) for c in cols}}
    )
    work = cut_lineage(work)
    before: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        moved = 0.0
        for target in gaps:
            observed = fixed + _moments(work.where(~F.col(f"_m_{target}")), cols)
            t = cols.index(target) + 1
            rest = [i for i in range(len(cols) + 1) if i != t]
            a = observed[np.ix_(rest, rest)] + ridge * np.diag([0.0] + [observed[0, 0]] * (len(rest) - 1))
            beta = np.linalg.lstsq(a, observed[rest, t], rcond=None)[0]
            moved = max(moved, float(np.abs(beta - before.get(target, 0.0)).max()))
            before[target] = beta
            others = [c for c in cols if c != target]
            guess = F.lit(float(beta[0]))
            for b, c in zip(beta[1:], others):
                guess = guess + F.lit(float(b)) * F.col(c)
            work = work.withColumn(target, F.when(F.col(f"_m_{target}"), guess).otherwise(F.col(target)))
        work = cut_lineage(work)
        if moved < tolerance:
            break
    back = work.withColumns({c: F.col(c) * F.lit(scale[c]) + F.lit(mean[c]) for c in cols}).select(*df.columns)
    return union_rows([df.where(~any_gap), back])
