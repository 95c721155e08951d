"""Projection, filtering and schema inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import (
    datetime_columns,
    distinct_per_column,
    numeric_columns,
    parse_datetime,
    parse_datetime_any,
    per_column,
    text_columns,
)

# Name fragments that suggest an identifier, and roles suggested by names.
ID_NAME_PARTS = ("id", "num", "code", "no", "key", "uuid", "guid")
ROLE_NAME_PARTS = {
    "customer": ("customer", "client", "user", "id"),
    "date": ("date", "time", "invoice", "purchase"),
    "quantity": ("quantity", "qty", "amount", "count"),
    "price": ("price", "value", "revenue", "sales"),
}


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    return {
        "numeric": numeric_columns(df),
        "categorical": text_columns(df),
        "datetime": datetime_columns(df),
    }


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*columns_by_kind(df)[kind])


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first n rows; give ``order_by`` for a repeatable answer."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def standardise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get _1, _2, ... from the second occurrence on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(name if k == 0 else f"{name}_{k}")
    return out


def with_unique_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent non-null values, ties by value."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), col)
        .limit(n)
    )


def keep_top_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows of the n most frequent categories; n is checked small, so the list is broadcast."""
    if n > 10_000:
        return df.join(top_values(df, col, n).select(col), col, "left_semi")
    return df.join(F.broadcast(top_values(df, col, n).select(col)), col, "left_semi")


def drop_bad_dates(df: DataFrame, col: str, pattern: str | None = None) -> DataFrame:
    """Replace the text by a timestamp and drop rows where it does not parse."""
    parsed = parse_datetime(col, pattern) if pattern else parse_datetime_any(col)
    return df.withColumn(col, parsed).where(F.col(col).isNotNull())


def valid_transactions(df: DataFrame, customer: str, amount: str) -> DataFrame:
    return df.where(F.col(customer).isNotNull() & F.col(amount).isNotNull() & (F.col(amount) > 0))


def dtype_listing(df: DataFrame) -> DataFrame:
    rows = [(i, n, t) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def dtype_counts(df: DataFrame) -> DataFrame:
    return dtype_listing(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))


def semantic_types(df: DataFrame) -> DataFrame:
    """numeric, datetime, boolean, categorical (< half of the rows distinct) or text."""
    kinds = dict(df.dtypes)
    numeric, dates = set(numeric_columns(df)), set(datetime_columns(df))
    prof = per_column(
        df,
        df.columns,
        {
            "n_rows": lambda c: F.count(F.lit(1)),
            "n_null": lambda c: F.count_if(F.col(c).isNull()),
        },
    )
    open_kind = [c for c in df.columns if c not in numeric and c not in dates and kinds[c] != "boolean"]
    if open_kind:
        prof = prof.join(F.broadcast(distinct_per_column(df, open_kind)), "column", "left")
    else:
        prof = prof.withColumn("n_distinct", F.lit(None).cast("bigint"))
    fixed = F.create_map(
        *[
            F.lit(x)
            for c in df.columns
            for x in (c, "numeric" if c in numeric else "datetime" if c in dates else "boolean" if kinds[c] == "boolean" else "")
        ]
    )
    by_name = fixed[F.col("column")]
    return prof.select(
        "column",
        F.when(by_name != "", by_name)
        .when(F.col("n_distinct") < F.col("n_rows") * 0.5, "categorical")
        .otherwise("text")
        .alias("semantic_type"),
        "n_rows",
        "n_null",
    )


def suggest_roles(df: DataFrame) -> dict[str, list[str]]:
    """Columns whose names suggest a customer, date, quantity or price."""
    return {
        role: [c for c in df.columns if any(p in c.lower() for p in parts)]
        for role, parts in ROLE_NAME_PARTS.items()
    }


def role_table(df: DataFrame) -> DataFrame:
    """(role, column, non-null rows) for the suggested columns."""
    roles = [(r, c) for r, cols in suggest_roles(df).items() for c in cols]
    if not roles:
        return df.sparkSession.createDataFrame([], "role string, column string, n_known bigint")
    wide = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, (_, c) in enumerate(roles)])
    rows = [
        F.struct(F.lit(r).alias("role"), F.lit(c).alias("column"), F.col(f"n{i}").alias("n_known"))
        for i, (r, c) in enumerate(roles)
    ]
    return wide.select(F.inline(F.array(*rows)))


def id_like_columns(df: DataFrame) -> DataFrame:
    """Per column: share of distinct values and whether it looks like an identifier."""
    text = set(text_columns(df))
    # Texts that look like identifiers.
    mixed = r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]"
    coded = r"^[A-Za-z\-]+[0-9]+$|^[0-9]+[-_/][0-9A-Za-z]+$"

    def pattern(c: str):
        if c not in text:
            return F.lit(False)
        return F.coalesce(F.bool_or(F.col(c).rlike(mixed) | F.col(c).rlike(coded)), F.lit(False))

    prof = per_column(df, df.columns, {"_n": lambda c: F.count(F.lit(1)), "has_pattern": pattern})
    prof = prof.join(F.broadcast(distinct_per_column(df, df.columns)), "column").withColumn(
        "unique_ratio", F.try_divide("n_distinct", "_n")
    )
    named = [c for c in df.columns if any(p in c.lower() for p in ID_NAME_PARTS)]
    high = F.col("unique_ratio") > 0.8
    reason = (
        F.when(high & F.col("column").isin(named), "name")
        .when(high & F.col("has_pattern"), "pattern")
        .when(F.col("unique_ratio") > 0.95, "unique")
    )
    return prof.select(
        "column", "unique_ratio", "has_pattern", reason.isNotNull().alias("is_id"), reason.alias("reason")
    )


def likely_date_columns(df: DataFrame) -> DataFrame:
    """Text columns where some value parses as a date and less than half of the rows fail."""
    prof = per_column(
        df,
        text_columns(df),
        {"n_rows": lambda c: F.count(F.lit(1)), "n_parsed": lambda c: F.count(parse_datetime_any(c))},
    )
    failed = F.try_divide(F.col("n_rows") - F.col("n_parsed"), F.col("n_rows"))
    return prof.withColumn("is_date", (F.col("n_parsed") > 0) & (failed < 0.5))
