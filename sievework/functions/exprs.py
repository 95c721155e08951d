"""Column expressions used by several operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import union_rows


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN in floating columns becomes NULL."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns]
    )


def to_double(c: str | Column) -> Column:
    """Number or NULL; text that is not a finite number is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


_FIELD = {
    "yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": "(0?[1-9]|1[0-2])",
    "dd": r"(0?[1-9]|[12]\d|3[01])", "HH": r"([01]?\d|2[0-3])", "mm": r"[0-5]?\d", "ss": r"[0-5]?\d",
}


def date_shape(pattern: str) -> str:
    """Regular expression of the texts a date pattern can match, value ranges included."""
    parts = re.findall(r"y+|M+|d+|H+|m+|s+|.", pattern)
    return "^" + "".join(_FIELD.get(p, re.escape(p)) for p in parts) + "$"


def _lenient(pattern: str) -> str:
    """The same pattern with one or two digits for day, month and time."""
    short = {"MM": "M", "dd": "d", "HH": "H", "mm": "m", "ss": "s"}
    return "".join(short.get(p, p) for p in re.findall(r"y+|M+|d+|H+|m+|s+|.", pattern))


def parse_datetime(c: str | Column, pattern: str | None = None) -> Column:
    """Timestamp without zone, or NULL when the text does not parse.

    The regular expression in front is compiled code; a failed parse costs an exception, so
    only texts of the right shape are parsed.
    """
    c = F.col(c) if isinstance(c, str) else c
    if pattern is None:
        shaped, ts = c.cast("string").rlike(_ISO), F.try_to_timestamp(c)
    else:
        shaped, ts = c.rlike(date_shape(pattern)), F.try_to_timestamp(c, F.lit(_lenient(pattern)))
        if "yyyy" not in pattern and "yy" in pattern:
            # Two digits mean 1969 to 2068.
            ts = F.when(F.year(ts) > 2068, ts - F.make_ym_interval(F.lit(100))).otherwise(ts)
    return F.when(shaped, ts).cast("timestamp_ntz")


_ISO = r"^\d{4}-\d{1,2}(-\d{1,2}.*)?$"

# Date forms of common texts, each also with a time of day behind it.
COMMON_FORMS = (
    "MM/dd/yyyy", "yyyy/MM/dd", "MM/dd/yy",
    "MM-dd-yyyy", "MM.dd.yyyy", "yyyy.MM.dd", "yyyyMMdd",
    "dd-MMM-yyyy", "dd-MMMM-yyyy", "dd-MMM-yy", "dd-MMMM-yy",
    "dd MMM yyyy", "dd MMMM yyyy",
    "MMM dd, yyyy", "MMMM dd, yyyy", "MMM dd yyyy", "MMMM dd yyyy",
)

LONGEST = 64
#: Date, then hours, minutes, perhaps seconds with a fraction, perhaps AM or PM.
_TIMED = r"^(.*\S)\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d{1,9})?))?(?:\s?([AaPp])[Mm])?$"


def _shape(text: Column) -> Column:
    """What a date form can be told by: runs of digits by length (8: D, 4: y, 1 or 2: 9), words by length."""
    shape = F.translate(text, "0123456789", "9" * 10)
    shape = F.regexp_replace(F.regexp_replace(shape, "[A-Za-z]{4,}", "L"), "[A-Za-z]{3}", "m")
    for run, sign in (("9" * 8, "D"), ("9" * 4, "y"), ("99", "9")):
        shape = F.replace(shape, F.lit(run), F.lit(sign))
    return shape


def _shape_of_form(form: str) -> str:
    signs = {"yyyyMMdd": "D", "yyyy": "y", "yy": "9", "MMMM": "L", "MMM": "m", "MM": "9", "dd": "9"}
    return re.sub("yyyyMMdd|y+|M+|d+", lambda m: signs[m.group()], form)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once; a chain of conditions would repeat it in every branch."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _by_shape(text: Column, shape: Column) -> Column:
    out = F
    for form in COMMON_FORMS:
        pattern = _lenient(form) if form != "yyyyMMdd" else form
        ts = F.try_to_timestamp(text, F.lit(pattern))
        if form.startswith("MM") and form[2] in "/-.":
            swapped = F.try_to_timestamp(text, F.lit(pattern.replace("M", "#").replace("d", "M").replace("#", "d")))
            ts = F.when(F.substring_index(text, form[2], 1).try_cast("int") > 12, swapped).otherwise(ts)
        if "yyyy" not in form:
            # Two digits mean 1969 to 2068.
            ts = F.when(F.year(ts) > 2068, ts - F.make_ym_interval(F.lit(100))).otherwise(ts)
        out = out.when(shape == _shape_of_form(form), ts.cast("timestamp_ntz"))
    return out


def _date_of(text: Column) -> Column:
    """Midnight of the date that ``text`` names in one of the common forms; a weekday in front is left out.

    Numbers are month, day; where the first is above 12, day, month.
    """
    comma = F.instr(text, ",")
    weekday = _shape(F.left(text, comma)).isin("m,", "L,")
    bare = F.when((comma > 0) & weekday, F.ltrim(F.substr(text, comma + 1))).otherwise(text)
    return _let(bare, lambda t: _let(_shape(t), lambda shape: _by_shape(t, shape)))


def parse_datetime_any(c: str | Column) -> Column:
    """ISO text, then the common form that the text's shape belongs to; any date column as it is.

    The form is looked up by shape, so a text meets one parser; a time of day is read apart from it.
    No common form is longer than ``LONGEST`` bytes.
    """
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    timed = F.contains(text, F.lit(":"))

    def part(i: int) -> Column:
        return F.regexp_extract(text, _TIMED, i)

    hour, minute = part(2).try_cast("int"), part(3).try_cast("int")
    second = F.when(part(4) == "", F.lit(0)).otherwise(part(4).try_cast("decimal(18,6)"))
    half = F.lower(part(5))
    hour = F.when(half == "", F.when(hour < 24, hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    clock = F.when((minute < 60) & (second < 60), F.make_dt_interval(F.lit(0), hour, minute, second))
    date = _date_of(F.when(timed, part(1)).otherwise(text))
    common = F.when(F.octet_length(text) <= LONGEST, F.when(timed, date + clock).otherwise(date))
    return F.when(c.cast("string").rlike(_ISO), parse_datetime(c)).otherwise(common)


# Coefficients of Acklam's published rational approximation of the inverse
# normal distribution function.
ACKLAM_A = (-39.6968302866538, 220.946098424521, -275.928510446969, 138.357751867269, -30.6647980661472, 2.50662827745924)
ACKLAM_B = (-54.4760987982241, 161.585836858041, -155.698979859887, 66.8013118877197, -13.2806815528857)
ACKLAM_C = (-0.00778489400243029, -0.322396458041136, -2.40075827716184, -2.54973253934373, 4.37466414146497, 2.93816398269878)
ACKLAM_D = (0.00778469570904146, 0.32246712907004, 2.445134137143, 3.75440866190742)
ACKLAM_SPLIT = 0.02425


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """z with P(Z <= z) = p for 0 < p < 1, else NULL."""
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = _horner(ACKLAM_C, tail) / _horner((*ACKLAM_D, 1.0), tail)
    q = p - 0.5
    r = q * q
    middle = _horner(ACKLAM_A, r) * q / _horner((*ACKLAM_B, 1.0), r)
    return F.when((p > 0) & (p < ACKLAM_SPLIT), outer).when(
        (p >= ACKLAM_SPLIT) & (p <= 1 - ACKLAM_SPLIT), middle
    ).when((p > 1 - ACKLAM_SPLIT) & (p < 1), -outer)


def per_column(df: DataFrame, cols: list[str], metrics: dict) -> DataFrame:
    """One scan, one row per column: ``metrics`` maps a result name to ``f(column name)``."""
    wide = df.agg(*[fn(c).alias(f"m{i}_{name}") for i, c in enumerate(cols) for name, fn in metrics.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"m{i}_{name}").alias(name) for name in metrics])
        for i, c in enumerate(cols)
    ]
    return wide.select(F.inline(F.array(*rows)))


def distinct_per_column(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_distinct) of non-null values, exact.

    Each column is counted on its own: a narrow scan, a map-side combine, and a shuffle of
    that column's distinct values only.  Several distinct counts in one aggregation would copy
    every row once per column first.
    """
    parts = []
    for c in cols:
        q = F.col(f"`{c}`")
        levels = df.where(q.isNotNull()).groupBy(q.alias("_v")).agg(F.lit(1).alias("_one"))
        parts.append(levels.agg(F.count("_one").alias("n_distinct")).select(F.lit(c).alias("column"), "n_distinct"))
    return union_rows(parts)


def long_form(df: DataFrame, cols: list[str], kind: str = "string", keep: list[str] | None = None) -> DataFrame:
    """(column, value) rows, one per input row and column."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in cols]
    return df.select(*(keep or []), F.inline(F.array(*pairs)))
