"""Profiles: one scan for all columns, results as small DataFrames with one row per finding."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.exprs import (
    datetime_columns,
    distinct_per_column,
    long_form,
    numeric_columns,
    per_column,
    text_columns,
)
from sievework.functions.order_stats import exact_quantiles, grouped_quantiles
from sievework.operators.encode import levels_of
from sievework.operators.missing import missing_cells, missing_report
from sievework.operators.outliers import iqr_report
from sievework.operators.schema import dtype_counts, id_like_columns, likely_date_columns, top_values
from sievework.session import union_rows


def _with_quantiles(prof: DataFrame, df: DataFrame, cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Attach learned quantiles as literals, looked up by column name."""
    got = exact_quantiles(df, cols, list(probs.values()))
    for i, name in enumerate(probs):
        pairs = [F.lit(x).cast(t) for c in cols for x, t in ((c, "string"), (got[c][i], "double"))]
        prof = prof.withColumn(name, F.create_map(*pairs)[F.col("column")])
    return prof


def dataset_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, rows, missing count and percentage, distinct non-null values."""
    kinds = dict(df.dtypes)
    prof = per_column(
        df,
        df.columns,
        {
            "dtype": lambda c: F.lit(kinds[c]),
            "n_rows": lambda c: F.count(F.lit(1)),
            "n_missing": lambda c: F.count_if(F.col(f"`{c}`").isNull()),
            "pct_missing": lambda c: F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100,
        },
    )
    return prof.join(F.broadcast(distinct_counts(df, df.columns, approximate)), "column")


def dtype_overview(df: DataFrame) -> DataFrame:
    """Columns and missing cells per type."""
    kinds = dict(df.dtypes)
    prof = per_column(
        df, df.columns, {"dtype": lambda c: F.lit(kinds[c]), "n": lambda c: F.count_if(F.col(f"`{c}`").isNull())}
    )
    return prof.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n_missing"))


_NUMERIC = {
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
}


def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return _with_quantiles(per_column(df, cols, _NUMERIC), df, cols, {"median": 0.5})


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    cols = list(cols or df.columns)
    if approximate:
        return per_column(df, cols, {"n_distinct": lambda c: F.approx_count_distinct(F.col(f"`{c}`"))})
    return distinct_per_column(df, cols)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; grouped on all columns with a map-side count."""
    per_row = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def datetime_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(
        df,
        list(cols or datetime_columns(df)),
        {
            "min": lambda c: F.min(c).cast("timestamp_ntz"),
            "max": lambda c: F.max(c).cast("timestamp_ntz"),
            "range_days": lambda c: whole_days(F.min(c), F.max(c)),
        },
    )


def whole_days(start: Column, end: Column) -> Column:
    """Complete days from ``start`` to a later ``end``, whatever the session's time zone."""
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def column_stats(df: DataFrame, col: str) -> DataFrame:
    """(statistic, value as text) rows for one column of any kind."""
    base = {
        "count": F.count(F.lit(1)),
        "missing": F.count_if(F.col(col).isNull()),
        "unique": F.count_distinct(F.col(col)),
    }
    if col in datetime_columns(df):
        base |= {"min": F.min(col), "max": F.max(col), "range_days": whole_days(F.min(col), F.max(col))}
    row = df.agg(*[e.cast("string").alias(k) for k, e in base.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(k).alias("value")) for k in base])))


def top_values_share(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """The n most frequent values with their percentage of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return top_values(df, col, n).select(
        F.col(col).cast("string").alias("value"), "n_rows", (F.col("n_rows") * 100.0 / total).alias("pct")
    )


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max with exact interpolated quartiles."""
    cols = list(cols or numeric_columns(df))
    prof = per_column(df, cols, {"count": lambda c: F.count(c), **_NUMERIC})
    return _with_quantiles(prof, df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def categorical_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct values with NULL as a value, and the top value with count and percentage."""
    cols = list(cols or text_columns(df))
    counts = long_form(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Most rows first, then the smallest value, NULL last.
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value").isNull(), F.col("value")))
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        best.alias("top_value"),
        F.max("n").alias("top_count"),
        (F.max("n") * 100.0 / F.sum("n")).alias("top_pct"),
    )


def value_counts(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Top n values of each column: one narrow count and a top-n per column."""
    return union_rows(
        top_values(df, c, n).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "n_rows") for c in cols
    )


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """Value, count, percentage of the non-null rows with two digits."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.agg(F.count(col)).scalar()
    return counts.select("value", "n_rows", F.round(F.col("n_rows") * 100.0 / total, 2).alias("pct"))


def _rollup_other(df: DataFrame, col: str, shown: int, order: str) -> DataFrame:
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    by = {
        "frequency": [F.desc("n_rows"), F.asc("value")],
        "frequency_asc": [F.asc("n_rows"), F.asc("value")],
        "alphabetical": [F.asc("value")],
    }[order]
    # The number of levels is refused beyond 50 before this runs, so one task can rank them.
    rank = F.row_number().over(Window.orderBy(*by))
    return (
        counts.withColumn("value", F.when(rank <= shown, F.col("value")).otherwise("Other"))
        .groupBy("value")
        .agg(F.sum("n_rows").alias("n_rows"))
    )


def _check_levels(df: DataFrame, col: str, limit: int) -> int:
    n = df.where(F.col(col).isNotNull()).select(col).distinct().limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"{col} has more than {limit} distinct values")
    return n


def pie_shares(df: DataFrame, col: str) -> DataFrame:
    """Counts per value; more than 8 values become the top 7 and 'Other'; refused beyond 15."""
    n = _check_levels(df, col, 15)
    return _rollup_other(df, col, 7 if n > 8 else n, "frequency")


def category_distribution(df: DataFrame, col: str, order: str = "frequency") -> DataFrame:
    """Counts per value; more than 15 values become 15 and 'Other'; refused beyond 50."""
    n = _check_levels(df, col, 50)
    return _rollup_other(df, col, min(n, 15), order)


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def skewness_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    prof = per_column(df, list(cols or numeric_columns(df)), {"skewness": sample_skewness})
    s = F.col("skewness")
    label = (
        F.when(s > 1, "Highly right-skewed")
        .when(s > 0.5, "Moderately right-skewed")
        .when(F.abs(s) <= 0.5, "Approximately symmetric")
        .when(s > -1, "Moderately left-skewed")
        .otherwise("Highly left-skewed")
    )
    return prof.withColumn("interpretation", label).orderBy(F.desc(F.abs(s)), "column")


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """r of every pair of different columns (upper triangle), all in one scan."""
    cols = list(cols or numeric_columns(df))
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Long form (a, b, r) with both triangles and the diagonal."""
    cols = list(cols or numeric_columns(df))
    upper = correlation_pairs(df, cols)
    both = F.array(
        F.struct(F.col("column_a").alias("column_a"), F.col("column_b").alias("column_b"), F.col("r").alias("r")),
        F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), F.col("r").alias("r")),
    )
    # r(x, x) is 1 where x varies, and unknown where it does not.
    diagonal = per_column(df, cols, {"r": lambda c: F.when(F.var_pop(c) > 0, F.lit(1.0))}).select(
        F.col("column").alias("column_a"), F.col("column").alias("column_b"), "r"
    )
    return union_rows([upper.select(F.inline(both)), diagonal]).withColumn("r", F.round("r", digits))


def strong_pairs(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.7) -> DataFrame:
    return correlation_pairs(df, cols).where(F.abs("r") > limit)


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed; bins without rows show 0."""
    row = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    spark = df.sparkSession
    if row["lo"] is None:
        return spark.createDataFrame([], "bin int, bin_from double, bin_to double, n_rows bigint")
    lo, hi = row["lo"], row["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    spine = spark.range(bins, numPartitions=1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("bin_from"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_to"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def box_plot(df: DataFrame, col: str, group: str) -> DataFrame:
    """Per group: min, quartiles, max and the 1.5 IQR fences."""
    q = grouped_quantiles(df, [group], col, [0.0, 0.25, 0.5, 0.75, 1.0], ["min", "q25", "median", "q75", "max"])
    iqr = F.col("q75") - F.col("q25")
    return q.withColumn("fence_low", F.col("q25") - 1.5 * iqr).withColumn("fence_high", F.col("q75") + 1.5 * iqr)


def date_analysis(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(
        df,
        list(cols or datetime_columns(df)),
        {
            "min": lambda c: F.min(c).cast("timestamp_ntz"),
            "max": lambda c: F.max(c).cast("timestamp_ntz"),
            "range_days": lambda c: whole_days(F.min(c), F.max(c)),
            "weekend_rows": lambda c: F.count_if(F.dayofweek(c).isin(1, 7)),
            "weekday_rows": lambda c: F.count_if(F.dayofweek(c).between(2, 6)),
            "n_missing": lambda c: F.count_if(F.col(c).isNull()),
        },
    )


def _metrics(part: DataFrame, section: str, name: str, numbers: Sequence[str]) -> DataFrame:
    """(section, name, metric, value) rows out of a profile."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in numbers]
    return part.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.inline(F.array(*rows)))


def eda(df: DataFrame) -> dict[str, DataFrame]:
    """Shape, type counts, description, correlations and top categories."""
    shape = df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
    out = {"shape": shape, "dtypes": dtype_counts(df)}
    if numeric_columns(df):
        out["description"] = describe(df)
    if len(numeric_columns(df)) > 1:
        out["correlation"] = correlation_matrix(df)
    if text_columns(df):
        out["categories"] = value_counts(df, text_columns(df), 10)
    return out


def automated_eda(df: DataFrame) -> dict[str, DataFrame]:
    """The bundle above plus missing values, skew, outliers, strong pairs, cardinality, dates."""
    numeric, text = numeric_columns(df), text_columns(df)
    out = eda(df) | {"missing_cells": missing_cells(df), "missing": missing_report(df)}
    if numeric:
        out["skewed"] = skewness_table(df).where(F.abs("skewness") > 1)
        out["outliers"] = iqr_report(df, numeric)
    if len(numeric) > 1:
        out["strong_pairs"] = strong_pairs(df)
    if text:
        out["cardinality"] = distinct_counts(df, text).withColumn("high_cardinality", F.col("n_distinct") > 10)
        out["likely_dates"] = likely_date_columns(df)
    if datetime_columns(df):
        out["dates"] = date_analysis(df)
    return out


def eda_metrics(df: DataFrame) -> DataFrame:
    """The automated bundle flattened to one (section, name, metric, value) table."""
    parts = automated_eda(df)
    flat = [
        _metrics(parts["shape"].withColumn("_t", F.lit("table")), "shape", "_t", ["n_rows", "n_columns"]),
        _metrics(parts["missing_cells"].withColumn("_t", F.lit("table")), "missing", "_t", ["missing_cells", "pct_missing"]),
    ]
    if "description" in parts:
        flat.append(_metrics(parts["description"], "description", "column", ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]))
        flat.append(_metrics(parts["skewed"], "skewed", "column", ["skewness"]))
        flat.append(_metrics(parts["outliers"], "outliers", "column", ["n_outliers", "pct_outliers", "min_outlier", "max_outlier"]))
    if "strong_pairs" in parts:
        pairs = parts["strong_pairs"].withColumn("pair", F.concat_ws(" & ", "column_a", "column_b"))
        flat.append(_metrics(pairs, "strong_pairs", "pair", ["r"]))
    if "cardinality" in parts:
        flat.append(_metrics(parts["cardinality"], "cardinality", "column", ["n_distinct"]))
    if "dates" in parts:
        flat.append(_metrics(parts["dates"], "dates", "column", ["range_days", "weekend_rows", "weekday_rows", "n_missing"]))
    return union_rows(flat)


def insights(df: DataFrame) -> DataFrame:
    """(finding, n, recommendation) rows where a profile threshold is passed."""
    numeric, text = numeric_columns(df), text_columns(df)
    findings = [
        (missing_report(df), "columns with missing values", "fill or drop missing values"),
    ]
    if numeric:
        findings.append(
            (skewness_table(df).where(F.abs("skewness") > 1), "strongly skewed numeric columns", "transform skewed columns (log, power)")
        )
    if len(numeric) > 1:
        findings.append((strong_pairs(df), "strongly correlated pairs", "select features or reduce dimensions"))
    if text:
        findings.append(
            (distinct_counts(df, text).where("n_distinct > 10"), "columns with more than 10 categories", "group or encode wide categories")
        )
    rows = [
        part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(finding).alias("finding"), "n", F.lit(advice).alias("recommendation"))
        for part, finding, advice in findings
    ]
    return union_rows(rows).where("n > 0")


def trend_line(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Least-squares line y ~ x per category, or one line if there are more than 5."""
    fit = [
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
    ]
    if by is not None and df.select(by).distinct().limit(6).count() <= 5:
        return df.groupBy(F.col(by).alias("category")).agg(*fit)
    return df.agg(*fit).select(F.lit("overall").alias("category"), "slope", "intercept", "r2")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the combinations that occur with the totals of both levels, any number of levels.

    Combinations that are not listed are zero.  A hot level is one row per combination here.
    """
    seen = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = seen.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = seen.groupBy(a).agg(F.count(F.lit(1)).alias("n_row"))
    cols = seen.groupBy(b).agg(F.count(F.lit(1)).alias("n_col"))
    return cells.join(rows, a).join(cols, b).select(a, b, "n", "n_row", "n_col")


def contingency_grid(df: DataFrame, a: str, b: str, limit: int = 1000) -> DataFrame:
    """Counts of every combination of levels, zero cells included; ``limit`` levels a side at most."""
    cells = contingency(df, a, b).select(a, b, "n")
    la, lb = levels_of(df, a, limit), levels_of(df, b, limit)
    grid = df.sparkSession.createDataFrame([(v,) for v in la], df.select(a).schema).withColumn(
        b, F.explode(F.array(*[F.lit(v) for v in lb]).cast(f"array<{dict(df.dtypes)[b]}>"))
    )
    return grid.join(cells, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def target_preview(df: DataFrame, target: str) -> DataFrame:
    """describe of a numeric target, else the top 10 classes; more than 50 are refused."""
    if target in numeric_columns(df):
        return describe(df, [target])
    _check_levels(df, target, 50)
    return top_values(df, target, 10)


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, n_samples: int = 3) -> DataFrame:
    """Numeric range and mean, identifier flag, and the smallest few values as samples."""
    cols = list(cols or df.columns)
    numeric = set(numeric_columns(df))
    prof = per_column(
        df,
        cols,
        {
            "mean": lambda c: F.avg(c) if c in numeric else F.lit(None).cast("double"),
            "min": lambda c: F.min(c).cast("double") if c in numeric else F.lit(None).cast("double"),
            "max": lambda c: F.max(c).cast("double") if c in numeric else F.lit(None).cast("double"),
        },
    )
    samples = []
    for c in cols:
        samples.append(
            df.where(F.col(c).isNotNull())
            .select(F.lit(c).alias("column"), F.col(c).alias("_v"))
            .distinct()
            .orderBy("_v")
            .limit(n_samples)
            .groupBy("column")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("_v")), lambda v: v.cast("string")), ", ").alias("samples"))
        )
    ids = id_like_columns(df.select(*cols)).select("column", "is_id", "unique_ratio")
    return prof.join(F.broadcast(union_rows(samples)), "column", "left").join(F.broadcast(ids), "column")


def bar_chart(df: DataFrame, by: str, value: str, how: str = "sum") -> DataFrame:
    make = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[how]
    return df.groupBy(F.col(by).alias("x")).agg(make(value).alias("y"))


def line_chart(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).alias("x"), F.col(y).alias("y")).orderBy("x", "y")
