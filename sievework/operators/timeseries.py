"""Series at a calendar grain.

Raw rows are first reduced to one row per series and calendar bucket, with a map-side
combine, so that even a series holding a third of all rows is then only as long as its
calendar.  Windows run on that reduced table; a series that is long all the same is scanned
in slices (``functions.scans``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.order_stats import grouped_quantiles
from sievework.functions.scans import Run, centred_mean, exponential_means, moving_mean, scan_series
from sievework.session import union_rows

#: Points of one series that a window sorts in one task; longer ones are scanned in slices.
WINDOW_ROWS = 1_000_000

STEP = {"H": "1 hour", "D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}


def bucket_start(ts: str | Column, freq: str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    if freq == "H":
        # From the clock fields: no time zone, so no hour that is skipped or repeated.
        t = c.cast("timestamp_ntz")
        return t - F.make_dt_interval(mins=F.minute(t), secs=F.extract(F.lit("SECOND"), t))
    d = F.to_date(c)
    return {
        "D": d,
        "W": F.date_sub(d, F.weekday(d)),
        "M": F.trunc(d, "month"),
        "Q": F.trunc(d, "quarter"),
        "Y": F.trunc(d, "year"),
    }[freq]


def bucket_label(start: Column, freq: str) -> Column:
    """The hour or day itself, the Sunday that ends the week, or the last day of the period."""
    return {
        "H": start,
        "D": start,
        "W": F.date_add(start, 6),
        "M": F.last_day(start),
        "Q": F.last_day(F.add_months(start, 2)),
        "Y": F.last_day(F.add_months(start, 11)),
    }[freq]


def _next_start(start: Column, freq: str, steps: Column | int = 1) -> Column:
    n = F.lit(steps) if isinstance(steps, int) else steps
    months = {"M": 1, "Q": 3, "Y": 12}
    if freq == "H":
        return start + F.make_dt_interval(hours=n.cast("int"))
    if freq in months:
        return F.add_months(start, (n * months[freq]).cast("int"))
    return F.date_add(start, (n * {"D": 1, "W": 7}[freq]).cast("int"))


def resample(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, freq: str = "D", how: str = "mean"
) -> DataFrame:
    """One row per series and calendar bucket between its first and last date.

    Buckets without rows are kept: 0 for sum and count, NULL otherwise.
    """
    keys = list(keys)
    by_bucket = df.where(F.col(ts).isNotNull()).select(*keys, bucket_start(ts, freq).alias("_b"), F.col(value).alias("_v"))
    if how == "median":
        agg = grouped_quantiles(by_bucket, [*keys, "_b"], "_v", [0.5], ["value"])
    else:
        make = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
        agg = by_bucket.groupBy(*keys, "_b").agg(make("_v").alias("value"))
    # Series and first/last bucket come out of the reduced table, not the raw rows.
    ends = agg.groupBy(*keys).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    spine = ends.select(*keys, F.explode(F.expr(f"sequence(_lo, _hi, interval {STEP[freq]})")).alias("_b"))
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys] + [F.col("s._b") == F.col("a._b")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    filled = F.col("a.value")
    if how in ("sum", "count"):
        filled = F.coalesce(filled, F.lit(0).cast(dict(agg.dtypes)["value"]))
    return (
        spine.alias("s")
        .join(agg.alias("a"), cond, "left")
        .select(*[F.col(f"s.{k}").alias(k) for k in keys], bucket_label(F.col("s._b"), freq).alias("ts"), filled.alias("value"))
    )


def ordered_series(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Series in date order with the date as text; a range-partitioned sort."""
    return df.orderBy(*keys, ts, value).select(*keys, F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col(value).alias("value"))


def _ordered(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("ts")


def suggested_period(df: DataFrame, keys: Sequence[str], freq: str) -> DataFrame:
    """Season length per series: 24, 7, 4, 12 or 4 by frequency, capped by the number of points."""
    natural = {"H": 24, "D": 7, "W": 4, "M": 12, "Q": 4}.get(freq, 4)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    n = F.col("n_points")
    top = F.greatest(F.lit(3), F.least(F.floor(n / 2), F.lit(24)))
    wanted = F.least(F.lit(natural), F.greatest(F.lit(2), F.least(F.floor(n / 4), top)))
    period = F.least(F.greatest(F.lit(2), wanted), top).cast("int")
    return counts.withColumn("period", F.when(n >= 4, period))


def infer_frequency(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Median gap between distinct days of a series: D, M (25-32 days), Q (85-95), else D."""
    days = df.where(F.col(ts).isNotNull()).select(*keys, F.to_date(ts).alias("ts")).distinct()
    gaps = days.withColumn("_gap", F.date_diff("ts", F.lag("ts").over(_ordered(keys)))).where("_gap IS NOT NULL")
    med = grouped_quantiles(gaps, list(keys), "_gap", [0.5], ["median_gap"])
    whole = F.floor("median_gap")
    freq = F.when(whole.between(25, 32), "M").when(whole.between(85, 95), "Q").otherwise("D")
    return med.withColumn("freq", freq)


def decompose(
    df: DataFrame,
    keys: Sequence[str],
    period: int,
    model: str = "additive",
    extrapolate: bool = False,
) -> DataFrame:
    """Trend, seasonal and residual parts of (keys, ts, value) series at a regular grain.

    Trend is a centred moving average over one period (half weight at both ends when the
    period is even).  With ``extrapolate`` the missing ends follow the straight line through
    the nearest ``period`` trend points.
    """
    keys = list(keys)
    t = _with_trend(df, keys, period)
    if extrapolate:
        known = with_position(t.where("trend IS NOT NULL"), keys, "_up")
        counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_known"))
        ranked = _join_back(known, counts, keys)
        # The line goes through the first (last) ``period`` trend points.
        head, tail = F.col("_up") < period, F.col("_up") >= F.col("_known") - period
        fit = []
        for tag, part in (("h", head), ("t", tail)):
            y, x = F.when(part, F.col("trend")), F.when(part, F.col("_i").cast("double"))
            fit += [F.regr_slope(y, x).alias(f"_{tag}s"), F.regr_intercept(y, x).alias(f"_{tag}c")]
        lines = ranked.groupBy(*keys).agg(*fit, F.min("_i").alias("_first"), F.max("_i").alias("_last"))
        t = _join_back(t, lines, keys).withColumn(
            "trend",
            F.when(F.col("_i") < F.col("_first"), F.col("_hs") * F.col("_i") + F.col("_hc"))
            .when(F.col("_i") > F.col("_last"), F.col("_ts") * F.col("_i") + F.col("_tc"))
            .otherwise(F.col("trend")),
        )
    additive = model == "additive"
    loose = F.col("value") - F.col("trend") if additive else F.try_divide("value", "trend")
    phase = t.withColumn("_phase", F.col("_i") % period)
    means = phase.groupBy(*keys, "_phase").agg(F.avg(loose).alias("_m"))
    centre = F.avg("_m").over(Window.partitionBy(*keys))
    means = means.withColumn("seasonal", F.col("_m") - centre if additive else F.try_divide(F.col("_m"), centre)).drop("_m")
    out = _join_back(phase, means, [*keys, "_phase"])
    rest = (
        F.col("value") - F.col("trend") - F.col("seasonal")
        if additive
        else F.try_divide(F.try_divide("value", "seasonal"), F.col("trend"))
    )
    return out.select(*keys, "ts", "value", "trend", "seasonal", rest.alias("residual"))


def _with_trend(df: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Adds position ``_i`` and the centred moving average ``trend``."""
    half = period // 2
    if long_series(df, keys):

        def parts(run: Run) -> dict[str, np.ndarray]:
            return {"_i": run.position + np.arange(len(run.values)), "trend": centred_mean(run, period)}

        return scan_series(df, keys, "ts", "value", {"_i": "long", "trend": "double"}, parts, before=half, after=half)
    w = _ordered(keys)
    span = w.rowsBetween(-half, half)
    weight_sum = F.sum("value").over(span)
    if period % 2 == 0:
        ends = F.lag("value", half).over(w) + F.lead("value", half).over(w)
        smooth = (weight_sum - ends / 2) / period
    else:
        smooth = weight_sum / period
    full = F.count("value").over(span) == 2 * half + 1
    return df.withColumn("_i", F.row_number().over(w) - 1).withColumn("trend", F.when(full, smooth))


def _join_back(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join on the keys that keeps the left column names; with no key, one row right."""
    extra = [c for c in right.columns if c not in keys]
    if not keys:
        one = right.select(F.struct(*extra).alias("_all")).scalar()
        return left.withColumn("_all", one).select(*left.columns, *[F.col(f"_all.{c}").alias(c) for c in extra])
    r = right.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *extra)
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    return left.join(r, cond).select(*left.columns, *extra)


def future_dates(df: DataFrame, keys: Sequence[str], freq: str, periods: int) -> DataFrame:
    """``periods`` bucket labels after the last one of each series; step counts from 1."""
    ends = df.groupBy(*keys).agg(F.max("ts").alias("_last"))
    start = bucket_start(F.col("_last"), freq)
    ahead = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return ahead.select(*keys, bucket_label(_next_start(start, freq, F.col("step")), freq).alias("ts"), "step")


def _history_and_future(history: DataFrame, future: DataFrame) -> DataFrame:
    return union_rows([history.withColumn("kind", F.lit("history")), future.withColumn("kind", F.lit("forecast"))])


def forecast_sma(df: DataFrame, keys: Sequence[str], freq: str, periods: int = 10, window: int = 3) -> DataFrame:
    """Moving average of the last ``window`` points, flat after the end."""
    keys = list(keys)
    return _flat_forecast(with_moving_mean(df, keys, window, "fitted"), keys, freq, periods)


def with_moving_mean(df: DataFrame, keys: Sequence[str], rows: int, name: str) -> DataFrame:
    """Mean of the last ``rows`` points of a (keys, ts, value) series, NULL until there are enough."""
    if long_series(df, keys):
        return scan_series(df, keys, "ts", "value", {name: "double"}, lambda run: {name: moving_mean(run, rows)}, before=rows - 1)
    w = _ordered(keys).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.when(F.count("value").over(w) == rows, F.avg("value").over(w)))


def with_position(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Adds the number of points of the series before each one."""
    if long_series(df, keys):
        return scan_series(df, keys, "ts", "value", {name: "long"}, lambda run: {name: run.position + np.arange(len(run.values))})
    return df.withColumn(name, (F.row_number().over(_ordered(keys)) - 1).cast("long"))


def long_series(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether some series has more points than one window task should sort."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (top or 0) > WINDOW_ROWS


def _flat_forecast(fitted: DataFrame, keys: list[str], freq: str, periods: int) -> DataFrame:
    last = fitted.groupBy(*keys).agg(F.max_by("fitted", "ts").alias("fitted"))
    future = _join_back(future_dates(fitted, keys, freq, periods), last, keys)
    return _history_and_future(
        fitted.select(*keys, "ts", "value", "fitted"),
        future.select(*keys, "ts", F.lit(None).cast("double").alias("value"), "fitted"),
    )


def forecast_ema(df: DataFrame, keys: Sequence[str], freq: str, periods: int = 10, alpha: float = 0.3) -> DataFrame:
    """Exponentially weighted mean with weights that sum to one, flat after the end."""
    keys = list(keys)
    return _flat_forecast(exponential_mean(df, keys, alpha), keys, freq, periods)


def exponential_mean(df: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """Adds ``fitted``: weights (1 - alpha)^age over the known values so far, scaled to sum to one.

    A linear recurrence scanned over slices of the sorted series; a missing value ages the others
    and shows their mean.
    """
    keep = 1.0 - alpha
    rows = df.select(*keys, "ts", F.col("value").cast("double").alias("value"))
    return scan_series(rows, keys, "ts", "value", {"fitted": "double"}, lambda run: {"fitted": exponential_means(run, keep)}, keep=keep)


def forecast_linear(df: DataFrame, keys: Sequence[str], freq: str, periods: int = 10) -> DataFrame:
    """Least-squares line on the position of the point, continued after the end."""
    keys = list(keys)
    t = with_position(df, keys, "_i").withColumn("_i", F.col("_i").cast("double"))
    lines = t.groupBy(*keys).agg(
        F.regr_slope("value", "_i").alias("_s"), F.regr_intercept("value", "_i").alias("_c"), F.max("_i").alias("_n")
    )
    past = _join_back(t, lines, keys)
    ahead = _join_back(future_dates(df, keys, freq, periods), lines, keys)
    return _history_and_future(
        past.select(*keys, "ts", "value", (F.col("_s") * F.col("_i") + F.col("_c")).alias("fitted")),
        ahead.select(
            *keys,
            "ts",
            F.lit(None).cast("double").alias("value"),
            (F.col("_s") * (F.col("_n") + F.col("step")) + F.col("_c")).alias("fitted"),
        ),
    )


# --- forecast accuracy --------------------------------------------------------------------


def accuracy_rows(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    """A/F, error and percentage error per row; the percentage is of the forecast."""
    a, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    pct = F.try_divide(a - f, f) * 100
    return df.where(a.isNotNull() & f.isNotNull()).withColumns(
        {
            "af_ratio": F.try_divide(a, f),
            "error": a - f,
            "abs_error": F.abs(a - f),
            "pct_error": pct,
            "abs_pct_error": F.abs(pct),
        }
    )


def accuracy_by(df: DataFrame, keys: Sequence[str], actual: str, forecast: str, digits: int = 2) -> DataFrame:
    """Totals and mean errors per product (or over everything with no key)."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    totals = {
        "demand": F.sum(actual),
        "forecast": F.sum(forecast),
        "af_ratio": F.avg("af_ratio"),
        "error": F.sum("error"),
        "abs_error": F.sum("abs_error"),
        "mape": F.avg("abs_pct_error"),
    }
    return accuracy_rows(df, actual, forecast).groupBy(*keys).agg(
        *[F.round(e, digits).alias(name) for name, e in totals.items()]
    )


def accuracy_overall(df: DataFrame, actual: str, forecast: str, keys: Sequence[str] = ()) -> DataFrame:
    rows = accuracy_rows(df, actual, forecast)
    e = F.col("error")
    return rows.groupBy(*keys).agg(
        F.sum(actual).alias("total_demand"),
        F.sum(forecast).alias("total_forecast"),
        F.try_divide(F.sum(actual), F.sum(forecast)).alias("overall_af"),
        F.avg("abs_error").alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg("abs_pct_error").alias("mape"),
    )


def aggregation_error(df: DataFrame, store: str, actual: str, forecast: str) -> DataFrame:
    """Absolute error in percent of the forecast, per store and for the pooled total."""
    sums = df.rollup(store).agg(F.sum(actual).alias("actual"), F.sum(forecast).alias("forecast"), F.grouping(store).alias("_g"))
    err = F.abs(F.col("actual") - F.col("forecast"))
    return sums.select(
        F.when(F.col("_g") == 1, "Total").otherwise(F.col(store).cast("string")).alias("store"),
        "actual",
        "forecast",
        err.alias("abs_error"),
        F.round(F.try_divide(err, F.col("forecast")) * 100, 1).alias("error_pct"),
    )
