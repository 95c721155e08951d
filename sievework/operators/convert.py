"""Type conversion.  A value that does not convert becomes NULL unless stated otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import (
    date_shape,
    numeric_columns,
    parse_datetime,
    parse_datetime_any,
    per_column,
    text_columns,
    to_double,
)
from sievework.session import union_rows

# Date patterns in the order in which they are tried.
DATE_PATTERNS = (
    "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd",
    "dd-MM-yyyy", "MM-dd-yyyy", "yyyy.MM.dd", "dd.MM.yyyy",
    "dd-MMM-yyyy", "dd-MMMM-yyyy", "MMM-dd-yyyy", "MMMM-dd-yyyy",
    "dd-MMM-yy", "dd-MMMM-yy", "MMM-dd-yy", "MMMM-dd-yy",
    "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
    "dd-MM-yyyy HH:mm:ss", "MM-dd-yyyy HH:mm:ss",
)

# Names (with _ read as a space) that are made numeric on load.
NUMERIC_NAMES = ("quantity", "price", "customer id", "invoice", "stockcode", "stock code")


_DIGITS = r"^\s*[+-]?[0-9]+\s*$"


def to_integer(c: str):
    """Whole numbers only: 2.5 has no integer form and becomes NULL.

    Digits are read as they are; other forms (2.0, 1e3) go through a double.
    """
    c = F.col(c) if isinstance(c, str) else c
    x = to_double(c)
    digits = c.cast("string").rlike(_DIGITS)
    return F.when(digits, c.cast("string").try_cast("bigint")).when(x == F.floor(x), x.try_cast("bigint"))


def convert_columns(df: DataFrame, conversions: Mapping[str, str]) -> DataFrame:
    """``{column: numeric | float | int | datetime | category | string}``."""
    makers = {
        "numeric": to_double,
        "float": to_double,
        "int": to_integer,
        "datetime": parse_datetime_any,
        "category": lambda c: F.col(c).cast("string"),
        "string": lambda c: F.col(c).cast("string"),
        "str": lambda c: F.col(c).cast("string"),
    }
    return df.withColumns({c: makers[kind](c) for c, kind in conversions.items()})


def to_datetime_strict(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Fails the job on the first value that does not match the pattern."""
    bad = F.raise_error(F.concat(F.lit(f"{col}: not a {pattern} date: "), F.col(col)))
    ts = parse_datetime(col, pattern)
    return df.withColumn(
        col, F.when(F.col(col).isNull() | ts.isNotNull(), ts).otherwise(bad.cast("timestamp_ntz"))
    )


def conversion_gaps(df: DataFrame, cols: Sequence[str], parser=to_double) -> DataFrame:
    """Per text column: NULLs before and after parsing, and whether it is worth converting."""
    prof = per_column(
        df,
        list(cols),
        {
            "null_before": lambda c: F.count_if(F.col(c).isNull()),
            "null_after": lambda c: F.count_if(parser(c).isNull()),
        },
    )
    return prof.withColumn("converts", F.col("null_after") <= F.col("null_before") * 1.1)


def auto_numeric(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Text columns become numbers if that adds at most a tenth to their NULLs."""
    cols = text_columns(df)
    if not cols:
        return df, []
    chosen = [r["column"] for r in conversion_gaps(df, cols).where("converts").collect()]
    return df.withColumns({c: to_double(c) for c in chosen}), chosen


def auto_datetime(df: DataFrame) -> tuple[DataFrame, list[str]]:
    cols = text_columns(df)
    if not cols:
        return df, []
    chosen = [r["column"] for r in conversion_gaps(df, cols, parse_datetime_any).where("converts").collect()]
    return df.withColumns({c: parse_datetime_any(c) for c in chosen}), chosen


def date_pattern_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, position, pattern, n_known, n_matches: how many values each pattern parses.

    A first scan of all columns finds the patterns whose shape fits any value; a second one
    parses with those only.
    """
    def named(i: int, j: int) -> str:
        return f"c{i}_{j}"

    shapes = df.agg(
        F.count(F.lit(1)),
        *[F.max(F.col(c).rlike(date_shape(p))).alias(named(i, j)) for i, c in enumerate(cols) for j, p in enumerate(DATE_PATTERNS)],
    ).first()
    seen = [(i, j) for i in range(len(cols)) for j in range(len(DATE_PATTERNS)) if shapes[named(i, j)]]
    counts = [F.count(parse_datetime(cols[i], DATE_PATTERNS[j])).alias(named(i, j)) for i, j in seen]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(j).alias("position"),
            F.lit(p).alias("pattern"),
            F.col(f"known{i}").alias("n_known"),
            (F.col(named(i, j)) if (i, j) in set(seen) else F.lit(0).cast("bigint")).alias("n_matches"),
        )
        for i, c in enumerate(cols)
        for j, p in enumerate(DATE_PATTERNS)
    ]
    wide = df.agg(*[F.count(c).alias(f"known{i}") for i, c in enumerate(cols)], *counts)
    return wide.select(F.inline(F.array(*rows)))


def pattern_matches(df: DataFrame, col: str) -> DataFrame:
    """Whether every known value parses, per date pattern, in the order of preference."""
    whole = (F.col("n_known") > 0) & (F.col("n_matches") == F.col("n_known"))
    return date_pattern_counts(df, [col]).select("position", "pattern", whole.alias("matches"))


def detect_date_patterns(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Per column the pattern that parses most values, the first of equals (all rows are read)."""
    best: dict[str, tuple[int, str]] = {}
    for r in date_pattern_counts(df, cols).orderBy("column", "position").collect():  # 22 rows a column
        if r["n_matches"] > best.get(r["column"], (0, ""))[0]:
            best[r["column"]] = (r["n_matches"], r["pattern"])
    return {c: best[c][1] if c in best else None for c in cols}


def detect_date_pattern(df: DataFrame, col: str) -> str | None:
    return detect_date_patterns(df, [col])[col]


def convert_datetime_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """By the pattern that parses most values; values that do not fit it become NULL."""
    found = detect_date_patterns(df, cols)
    return df.withColumns(
        {c: parse_datetime(c, p) if p else parse_datetime_any(c) for c, p in found.items()}
    )


def coerce_by_name(df: DataFrame) -> DataFrame:
    """Columns of number-like names become bigint if all their numbers are whole digits, else double."""
    already = set(numeric_columns(df))
    named = [c for c in df.columns if c.strip().lower().replace("_", " ") in NUMERIC_NAMES and c not in already]
    if not named:
        return df
    lost = [F.count_if(to_double(c).isNotNull() & (~F.col(c).cast("string").rlike(_DIGITS) | to_integer(c).isNull())) for c in named]
    checks = df.agg(*[(n == 0).alias(f"w{i}") for i, n in enumerate(lost)]).first()
    return df.withColumns({c: to_integer(c) if checks[f"w{i}"] else to_double(c) for i, c in enumerate(named)})


def strip_to_number(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop everything but digits, dot and minus, then convert."""
    return df.withColumns({c: to_double(F.regexp_replace(F.col(c), r"[^\d.-]", "")) for c in cols})


def unconvertible_examples(df: DataFrame, cols: Sequence[str], n: int = 3) -> DataFrame:
    """Up to n distinct values per column, smallest first, that are not numbers."""
    parts = []
    for c in cols:
        parts.append(
            df.where(F.col(c).isNotNull() & to_double(c).isNull())
            .select(F.lit(c).alias("column"), F.col(c).alias("example"))
            .distinct()
            .orderBy("example")
            .limit(n)
        )
    return union_rows(parts)
