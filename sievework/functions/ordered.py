"""Neighbouring known values in date order for series of any length.

A window over a whole series would put that series into one task.  Here each series is cut
into slices of the global date range, the window runs inside a slice, and a second window
over one summary row per slice carries counts and values across slice borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.order_stats import sampled_cuts, slice_of, value_slices
from sievework.session import parallelism


def as_number(df: DataFrame, col: str) -> Column:
    """An order-preserving double for a number, date or timestamp column."""
    kind = dict(df.dtypes)[col]
    c = F.col(col)
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "timestamp_ntz":
        # From the calendar fields: no time zone, so no hour that is skipped or repeated.
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")
        return F.unix_date(F.to_date(c)) * 86400.0 + seconds
    if kind == "date":
        return F.unix_date(F.col(col)).cast("double")
    return F.col(col).cast("double")


def with_slices(df: DataFrame, order: str, tie: str) -> DataFrame:
    """Add ``_slice``: rows of equal slice are close in (order, tie), and slices are ordered.

    A date that fills whole slices by itself is cut further along the tie-breaking key.
    """
    n = parallelism(df)
    o = as_number(df, order)
    first, hot = value_slices(df, o, n)
    if not hot:
        return df.withColumn("_slice", first)
    crowd = df.where(o.isin(hot))
    if dict(df.dtypes)[tie] == "string":
        keys = crowd.select(tie).where(F.col(tie).isNotNull()).distinct()
        second = F.coalesce(slice_of(F.col(tie), sampled_cuts(keys, tie, keys.count(), n)), F.lit(0))
    else:
        second, _ = value_slices(crowd, as_number(df, tie), n)
    # More than any number of slices within a hot date, so that the order is kept.
    room = 4 * n + 1024
    return df.withColumn("_slice", first * room + F.when(o.isin(hot), second).otherwise(0))


def with_known_neighbours(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, value: str
) -> DataFrame:
    """Add position, and value and position of the nearest known value at or before / after.

    Columns added: ``_pos, _prev, _prev_pos, _next, _next_pos`` (positions are 0-based inside
    the series; NULL where no such value exists).  Rows without a date are in no order: they go.
    """
    keys = list(keys)
    df = df.where(F.col(order).isNotNull())
    sliced = with_slices(df, order, tie)
    known = F.col(value).isNotNull()
    at = F.struct(F.col(order), F.col(tie))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order, tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # A frame that runs to the end is rebuilt for every row: read backwards instead.
    back = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(F.desc(order), F.desc(tie))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = sliced.withColumn("_lpos", F.row_number().over(inside) - 1)
    mark = F.when(known, F.struct(F.col(value).alias("v"), F.col("_lpos").alias("p")))
    local = (
        local.withColumn("_mark", mark)
        .withColumn("_lprev", F.last("_mark", ignorenulls=True).over(upto))
        .withColumn("_lnext", F.last("_mark", ignorenulls=True).over(back))
    )

    # One row per (series, slice): size, first and last known value with local positions.
    summary = local.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_size"),
        F.max_by("_mark", F.when(known, at)).alias("_lastm"),
        F.min_by("_mark", F.when(known, at)).alias("_firstm"),
    )
    over_slices = Window.partitionBy(*keys).orderBy("_slice")
    before = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)

    def shift(m: str) -> Column:
        return F.when(
            F.col(m).isNotNull(),
            F.struct(F.col(f"{m}.v").alias("v"), (F.col(f"{m}.p") + F.col("_off")).alias("p")),
        )

    carry = (
        summary.withColumn("_off", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_lastm", shift("_lastm"))
        .withColumn("_firstm", shift("_firstm"))
        .withColumn("_cin", F.last("_lastm", ignorenulls=True).over(before))
        .withColumn("_cout", F.last("_firstm", ignorenulls=True).over(after))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s2"), "_off", "_cin", "_cout")
    )
    on = F.col("_slice") == F.col("_s2")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carry, on)
    prev = F.coalesce(shift("_lprev"), F.col("_cin"))
    nxt = F.coalesce(shift("_lnext"), F.col("_cout"))
    return joined.select(
        *df.columns,
        (F.col("_lpos") + F.col("_off")).alias("_pos"),
        prev["v"].alias("_prev"),
        prev["p"].alias("_prev_pos"),
        nxt["v"].alias("_next"),
        nxt["p"].alias("_next_pos"),
    )
