"""The cleaning sequence: a fixed order of optional steps with a report of what each did."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import numeric_columns, text_columns
from sievework.operators.convert import auto_datetime, auto_numeric
from sievework.operators.missing import apply_fill, fill_values, mode_value
from sievework.operators.outliers import remove_zscore_outliers
from sievework.operators.schema import drop_duplicate_rows, drop_null_rows
from sievework.session import cut_lineage


@dataclass(frozen=True)
class CleaningSpec:
    drop_nulls: bool = False
    fill_mean: bool = False
    fill_mode: bool = False
    drop_duplicates: bool = False
    remove_outliers: bool = False
    convert_numeric: bool = False
    convert_datetime: bool = False


def _null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    if not cols:
        return {}
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(cols)}


def clean(df: DataFrame, spec: CleaningSpec, report: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Apply the chosen steps; the report costs one count per row-removing step."""
    lines: list[tuple[int, str, str | None, float | None, str | None]] = []

    def note(step: str, column: str | None = None, number: float | None = None, text: str | None = None) -> None:
        lines.append((len(lines), step, column, None if number is None else float(number), text))

    rows = df.count() if report else 0
    started = rows

    def removed(step: str, after: DataFrame) -> int:
        nonlocal rows
        if not report:
            return 0
        now = after.count()
        if now != rows:
            note(step, None, rows - now)
        rows = now
        return now

    if spec.drop_nulls:
        df = drop_null_rows(df)
        removed("drop_nulls", df)
    if spec.fill_mean:
        holes = [c for c, n in _null_counts(df, numeric_columns(df)).items() if n]
        values = fill_values(df, holes, "mean")
        df = apply_fill(df, values)
        for c, v in values.items():
            note("fill_mean", c, v)
    if spec.fill_mode:
        holes = [c for c, n in _null_counts(df, text_columns(df)).items() if n]
        values = {c: mode_value(df, c) for c in holes}
        df = apply_fill(df, {c: v for c, v in values.items() if v is not None})
        for c, v in values.items():
            note("fill_mode", c, None, v)
    if spec.drop_duplicates:
        df = drop_duplicate_rows(df)
        if spec.remove_outliers:
            # The outlier step reads the rows once per column: shuffle them only once.
            df = cut_lineage(df)
        removed("drop_duplicates", df)
    if spec.remove_outliers:
        df = remove_zscore_outliers(df)
        removed("remove_outliers", df)
    if spec.convert_numeric:
        df, chosen = auto_numeric(df)
        for c in chosen:
            note("convert_numeric", c)
    if spec.convert_datetime:
        df, chosen = auto_datetime(df)
        for c in chosen:
            note("convert_datetime", c)
    if not report:
        return df, None
    if rows != started:
        note("overall", None, started - rows, f"{rows} rows remaining")
    schema = "position int, step string, column string, number double, detail string"
    return df, df.sparkSession.createDataFrame(lines, schema)
