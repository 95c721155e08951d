"""Scalar transforms and scaling of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import numeric_columns, text_columns
from sievework.functions.order_stats import exact_quantiles
from sievework.operators.convert import unconvertible_examples
from sievework.operators.schema import id_like_columns


def _minima(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.min(c).cast("double").alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def log_shift(lowest: float | None) -> float:
    if lowest is None or lowest > 0:
        return 0.0
    return abs(lowest) + 1.0


def log_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ln(x + shift), the shift makes the smallest value positive."""
    lowest = _minima(df, cols)
    return df.withColumns({c: F.ln(F.col(c) + F.lit(log_shift(lowest[c]))) for c in cols})


def elementwise(df: DataFrame, col: str, operation: str, name: str) -> DataFrame:
    """New column from one: log, sqrt (NULL where undefined), square, cube or inverse."""
    x = F.col(col).cast("double")
    made = {
        "log": F.ln(x),
        "sqrt": F.when(x >= 0, F.sqrt(x)),
        "square": x * x,
        "cube": x * x * x,
        "inverse": F.try_divide(F.lit(1.0), x),
    }
    return df.withColumn(name, made[operation])


def root_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """sqrt(x); a negative x stays as it is."""
    return df.withColumns({c: F.when(F.col(c) < 0, F.col(c)).otherwise(F.sqrt(F.col(c))) for c in cols})


class Scaler:
    """(x - centre) / width per column, with learned centre and width."""

    def __init__(self, centre: Mapping[str, float], width: Mapping[str, float]):
        self.centre, self.width = dict(centre), dict(width)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(self.centre[c])) / F.lit(self.width[c]) for c in self.centre}
        )

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.width[c]) + F.lit(self.centre[c]) for c in self.centre})


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str) -> Scaler:
    """'standard' (population deviation), 'minmax' or 'robust' (median and quartile range)."""
    if kind == "robust":
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        known = [c for c in cols if q[c][0] is not None]
        return Scaler({c: q[c][1] for c in known}, {c: (q[c][2] - q[c][0]) or 1.0 for c in known})
    pair = {
        "standard": (F.avg, F.stddev_pop),
        "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
    }[kind]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [pair[0](c).cast("double").alias(f"c{i}"), pair[1](c).cast("double").alias(f"w{i}")]
    row = df.agg(*aggs).first()
    known = {c: i for i, c in enumerate(cols) if row[f"c{i}"] is not None}
    return Scaler({c: row[f"c{i}"] for c, i in known.items()}, {c: row[f"w{i}"] or 1.0 for c, i in known.items()})


def scale(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> DataFrame:
    return fit_scaler(df, cols, kind).transform(df)


def scale_guarded(
    df: DataFrame, cols: Sequence[str], kind: str = "standard", proceed_with_ids: bool = False
) -> DataFrame:
    """Refuse missing values, text that is no number, and (unless told) identifier columns."""
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    missing = [c for i, c in enumerate(cols) if gaps[f"n{i}"]]
    if missing:
        raise ValueError(f"missing values in {', '.join(missing)}: fill or drop them before scaling")
    text = [c for c in cols if c in text_columns(df)]
    if text:
        bad = unconvertible_examples(df, text).collect()
        if bad:
            shown = "; ".join(f"{r['column']}: {r['example']!r}" for r in bad)
            raise ValueError(f"values that are not numbers: {shown}")
        df = df.withColumns({c: F.col(c).try_cast("double") for c in text})
    if not proceed_with_ids:
        ids = [r["column"] for r in id_like_columns(df.select(*cols)).where("is_id").collect()]
        if ids:
            raise ValueError(f"{', '.join(ids)} look like identifiers: pass proceed_with_ids=True to scale them")
    return scale(df, cols, kind)


# --- power transforms ---------------------------------------------------------------------


def boxcox(x: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        return F.ln(x)
    return (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def yeo_johnson(x: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        up = F.log1p(x)
    else:
        up = (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    if abs(lam - 2.0) < 1e-12:
        down = -F.log1p(-x)
    else:
        down = -(F.pow(1 - x, F.lit(2.0 - lam)) - 1) / F.lit(2.0 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _best_lambda(
    df: DataFrame, col: str, power: Callable[[Column, float], Column], log_term: Column, lo: float, hi: float
) -> float:
    """Maximum likelihood by three rounds of a grid; a round is one scan for all its lambdas."""
    x = F.col(col).cast("double")
    points = 21
    for _ in range(3):
        grid = np.linspace(lo, hi, points)
        row = df.agg(
            F.count(x).alias("n"),
            F.sum(log_term).alias("s"),
            *[F.var_pop(power(x, float(g))).alias(f"v{i}") for i, g in enumerate(grid)],
        ).first()
        fit = [
            -row["n"] / 2 * math.log(row[f"v{i}"]) + (g - 1) * row["s"] if row[f"v{i}"] else -math.inf
            for i, g in enumerate(grid)
        ]
        best = int(np.argmax(fit))
        step = grid[1] - grid[0]
        lo, hi = grid[best] - step, grid[best] + step
    # A parabola through the best point and its neighbours.
    if 0 < best < points - 1 and math.isfinite(fit[best - 1]) and math.isfinite(fit[best + 1]):
        a, b, c = fit[best - 1], fit[best], fit[best + 1]
        if a - 2 * b + c < 0:
            return float(grid[best] + 0.5 * step * (a - c) / (a - 2 * b + c))
    return float(grid[best])


def boxcox_lambda(df: DataFrame, col: str, shift: float) -> float:
    x = F.col(col).cast("double") + F.lit(shift)
    moved = df.select(x.alias(col))
    return _best_lambda(moved, col, boxcox, F.ln(F.col(col)), -3.0, 3.0)


def boxcox_transform(df: DataFrame, cols: Sequence[str], lambdas: Mapping[str, float] | None = None) -> DataFrame:
    lowest = _minima(df, cols)
    new = {}
    for c in cols:
        shift = log_shift(lowest[c])
        lam = (lambdas or {}).get(c)
        if lam is None:
            lam = boxcox_lambda(df, c, shift)
        new[c] = boxcox(F.col(c).cast("double") + F.lit(shift), lam)
    return df.withColumns(new)


def yeo_johnson_lambda(df: DataFrame, col: str) -> float:
    x = F.col(col).cast("double")
    return _best_lambda(df, col, yeo_johnson, F.signum(x) * F.log1p(F.abs(x)), -3.0, 5.0)


def yeo_johnson_transform(
    df: DataFrame, cols: Sequence[str], lambdas: Mapping[str, float] | None = None
) -> DataFrame:
    """Power transform followed by standard scaling."""
    found = {c: (lambdas or {}).get(c) for c in cols}
    found = {c: yeo_johnson_lambda(df, c) if lam is None else lam for c, lam in found.items()}
    return scale(df.withColumns({c: yeo_johnson(F.col(c).cast("double"), lam) for c, lam in found.items()}), cols)


def skewed_columns(df: DataFrame, threshold: float = 0.5) -> list[str]:
    cols = numeric_columns(df)
    row = df.agg(*[F.skewness(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"s{i}"] is not None and abs(row[f"s{i}"]) > threshold]


def transform_skewed(df: DataFrame, threshold: float = 0.5, method: str = "yeo-johnson") -> DataFrame:
    """Treat only columns whose population skewness exceeds the threshold."""
    cols = skewed_columns(df, threshold)
    if not cols or method == "box-cox":
        return df
    if method == "yeo-johnson":
        return yeo_johnson_transform(df, cols)
    if method != "log":
        raise ValueError(method)
    lowest = _minima(df, cols)
    return df.withColumns(
        {c: F.log1p(F.col(c) + F.lit(0.0 if lowest[c] > 0 else 1.0 - lowest[c])) for c in cols}
    )


# --- new columns from several -------------------------------------------------------------


def combine_row(df: DataFrame, cols: Sequence[str], operation: str, name: str) -> DataFrame:
    """sum, mean, max, min or product over columns of a row, skipping NULLs."""
    xs = [F.col(c).cast("double") for c in cols]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    known = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    product = F.lit(1.0)
    for x in xs:
        product = product * F.coalesce(x, F.lit(1.0))
    made = {
        "sum": total,
        "mean": F.try_divide(total, known),
        "max": F.greatest(*xs) if len(xs) > 1 else xs[0],
        "min": F.least(*xs) if len(xs) > 1 else xs[0],
        "product": product,
    }
    return df.withColumn(name, made[operation])


def arithmetic(df: DataFrame, left: str, operation: str, right: str | float, name: str) -> DataFrame:
    """left (+ - * /) column or constant; division by zero gives NULL."""
    a = F.col(left).cast("double")
    b = F.col(right).cast("double") if isinstance(right, str) else F.lit(float(right))
    made = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}
    return df.withColumn(name, made[operation])


def date_features(df: DataFrame, col: str) -> DataFrame:
    d = F.col(col)
    return df.withColumns(
        {
            f"{col}_year": F.year(d),
            f"{col}_quarter": F.quarter(d),
            f"{col}_month": F.month(d),
            f"{col}_day": F.dayofmonth(d),
            f"{col}_weekday": F.dayofweek(d),
        }
    )


def polynomial_features(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    """All products of the columns up to the degree, as named columns."""
    level = {c: F.col(c).cast("double") for c in cols}
    new: dict[str, Column] = {}
    for _ in range(degree - 1):
        nxt = {}
        for name, expr in level.items():
            last = name.split("__")[-1]
            for c in list(cols)[list(cols).index(last) :]:
                nxt[f"{name}__{c}"] = expr * F.col(c).cast("double")
        new.update(nxt)
        level = nxt
    return df.withColumns(new)


def formula(df: DataFrame, expression: str, name: str) -> DataFrame:
    return df.withColumn(name, F.expr(expression))
