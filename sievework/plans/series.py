"""Queries for time series, forecasts and forecast accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import forecast, timeseries as ts
from sievework.operators.profile import describe
from sievework.plans.registry import query, rounded, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", "ts", "value")


def _daily(spark, sf_dir):
    """Daily event values per type; the calendar of a series has no holes."""
    return ts.resample(_events(spark, sf_dir), ["event_type"], "ts", "value", "D", "sum")


# The same reduced tables for the SQL side.
DAILY = """SELECT s.event_type, s.ts, coalesce(a.value, 0) AS value FROM (
  SELECT event_type, unnest(generate_series(min(ts::DATE), max(ts::DATE), INTERVAL 1 DAY))::DATE AS ts FROM events GROUP BY 1) s
  LEFT JOIN (SELECT event_type, ts::DATE AS ts, sum(value) AS value FROM events GROUP BY ALL) a ON a.event_type = s.event_type AND a.ts = s.ts"""


def _monthly(spark, sf_dir):
    # Divided by 97 so that no mean ends in a 5 where two engines would round it differently.
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", (F.col("o_totalprice") / 97).alias("price"))
    return ts.resample(o, ["o_orderpriority"], "o_orderdate", "price", "M", "mean")


MONTHLY = """SELECT s.o_orderpriority, last_day(s.b) AS ts, a.value FROM (
  SELECT o_orderpriority, unnest(generate_series(min(date_trunc('month', o_orderdate)::DATE), max(date_trunc('month', o_orderdate)::DATE), INTERVAL 1 MONTH))::DATE AS b FROM orders GROUP BY 1) s
  LEFT JOIN (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS b, avg(o_totalprice / 97) AS value FROM orders GROUP BY ALL) a ON a.o_orderpriority = s.o_orderpriority AND a.b = s.b"""


@query("f01_resample_day_sum", f"SELECT event_type, ts, round(value, 4) AS value FROM ({DAILY})")
def resample_day(spark, sf_dir):
    return rounded(_daily(spark, sf_dir), 4)


def _users(spark, sf_dir):
    """Events per user: most users have days without any."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "value")


def _users_sql(grain: str, step: str, agg: str) -> str:
    return f"""SELECT s.user_id, s.b, a.value FROM (
    SELECT user_id, unnest(generate_series(min(date_trunc('{grain}', ts)::DATE), max(date_trunc('{grain}', ts)::DATE), INTERVAL {step}))::DATE AS b FROM events GROUP BY 1) s
    LEFT JOIN (SELECT user_id, date_trunc('{grain}', ts)::DATE AS b, {agg}(value) AS value FROM events GROUP BY ALL) a ON a.user_id = s.user_id AND a.b = s.b"""


@query("f01_resample_day_mean", f"SELECT user_id, b AS ts, round(value, 6) AS value FROM ({_users_sql('day', '1 DAY', 'avg')})")
def resample_day_mean(spark, sf_dir):
    return rounded(ts.resample(_users(spark, sf_dir), ["user_id"], "ts", "value", "D", "mean"))


@query("f01_resample_day_min", f"SELECT user_id, b AS ts, value FROM ({_users_sql('day', '1 DAY', 'min')})")
def resample_day_min(spark, sf_dir):
    return ts.resample(_users(spark, sf_dir), ["user_id"], "ts", "value", "D", "min")


@query("f01_resample_week_count", f"SELECT user_id, (b + 6)::DATE AS ts, coalesce(value, 0) AS value FROM ({_users_sql('week', '7 DAY', 'count')})")
def resample_week_count(spark, sf_dir):
    return ts.resample(_users(spark, sf_dir), ["user_id"], "ts", "value", "W", "count")


@query("f01_resample_month_mean", f"SELECT o_orderpriority, ts, round(value, 6) AS value FROM ({MONTHLY})")
def resample_month(spark, sf_dir):
    return rounded(_monthly(spark, sf_dir))


@query(
    "f01_resample_quarter_median",
    """SELECT o_orderstatus, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS ts, round(median(o_totalprice), 6) AS value FROM orders GROUP BY ALL""",
)
def resample_quarter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_totalprice")
    return rounded(ts.resample(o, ["o_orderstatus"], "o_orderdate", "o_totalprice", "Q", "median"))


@query(
    "f01_resample_year_max",
    "SELECT (date_trunc('year', o_orderdate) + INTERVAL 11 MONTH + INTERVAL 30 DAY)::DATE AS ts, max(o_totalprice) AS value FROM orders GROUP BY ALL",
)
def resample_year(spark, sf_dir):
    return ts.resample(table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice"), [], "o_orderdate", "o_totalprice", "Y", "max")


@query("f02_ordered_series", "SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, o_totalprice AS value FROM orders")
def ordered_series(spark, sf_dir):
    return ts.ordered_series(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice")


def _decompose_sql(source: str, key: str, p: int, additive: bool, extrapolate: bool) -> str:
    h = p // 2
    sub = (lambda a, b: f"{a} - {b}") if additive else (lambda a, b: f"{a} / {b}")
    if p % 2 == 0:
        smooth = f"(sum(value) OVER c - (lag(value, {h}) OVER w + lead(value, {h}) OVER w) / 2) / {p}"
    else:
        smooth = f"sum(value) OVER c / {p}"
    trend = f"""t0 AS (SELECT *, CASE WHEN count(value) OVER c = {2 * h + 1} THEN {smooth} END AS t_raw, row_number() OVER w - 1 AS i FROM src
      WINDOW w AS (PARTITION BY {key} ORDER BY ts), c AS (PARTITION BY {key} ORDER BY ts ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING))"""
    if extrapolate:
        trend += f""", r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) AS up, row_number() OVER (PARTITION BY {key} ORDER BY i DESC) AS down FROM t0 WHERE t_raw IS NOT NULL),
        l AS (SELECT {key}, regr_slope(t_raw, i) FILTER (up <= {p}) AS hs, regr_intercept(t_raw, i) FILTER (up <= {p}) AS hc, regr_slope(t_raw, i) FILTER (down <= {p}) AS es,
          regr_intercept(t_raw, i) FILTER (down <= {p}) AS ec, min(i) AS f, max(i) AS z FROM r GROUP BY 1),
        t AS (SELECT t0.*, CASE WHEN i < f THEN hs * i + hc WHEN i > z THEN es * i + ec ELSE t_raw END AS trend FROM t0 JOIN l USING ({key}))"""
    else:
        trend += ", t AS (SELECT *, t_raw AS trend FROM t0)"
    return f"""WITH src AS ({source}), {trend},
    s AS (SELECT {key}, i % {p} AS ph, avg({sub('value', 'trend')}) AS m FROM t GROUP BY ALL),
    n AS (SELECT {key}, ph, {sub('m', f'avg(m) OVER (PARTITION BY {key})')} AS seasonal FROM s)
    SELECT t.{key}, ts, round(value, 4) AS value, round(trend, 4) AS trend, round(seasonal, 4) + 0.0 AS seasonal,
    round({'value - trend - seasonal' if additive else 'value / seasonal / trend'}, 4) + 0.0 AS residual FROM t JOIN n ON n.{key} = t.{key} AND n.ph = t.i % {p}"""


@query("f03_decompose_additive", _decompose_sql(DAILY, "event_type", 7, True, False))
def decompose_additive(spark, sf_dir):
    return rounded(ts.decompose(_daily(spark, sf_dir), ["event_type"], 7), 4)


@query("f03_decompose_multiplicative", _decompose_sql(MONTHLY, "o_orderpriority", 12, False, False))
def decompose_multiplicative(spark, sf_dir):
    return rounded(ts.decompose(_monthly(spark, sf_dir), ["o_orderpriority"], 12, "multiplicative"), 4)


@query("f04_decompose_extrapolated", _decompose_sql(MONTHLY, "o_orderpriority", 12, True, True))
def decompose_extrapolated(spark, sf_dir):
    return rounded(ts.decompose(_monthly(spark, sf_dir), ["o_orderpriority"], 12, extrapolate=True), 4)


@query(
    "f05_suggested_period",
    """SELECT o_orderpriority, n AS n_points, CASE WHEN n >= 4 THEN least(greatest(2, least(12, greatest(2, least(n // 4, top)))), top)::INTEGER END AS period
    FROM (SELECT o_orderpriority, n, greatest(3, least(n // 2, 24)) AS top FROM (SELECT o_orderpriority, datediff('month', min(o_orderdate), max(o_orderdate)) + 1 AS n FROM orders GROUP BY 1))""",
)
def suggested_period(spark, sf_dir):
    return ts.suggested_period(_monthly(spark, sf_dir), ["o_orderpriority"], "M")


def _frequency_sql(key: str, source: str) -> str:
    return f"""SELECT {key}, median(gap)::DOUBLE AS median_gap, CASE WHEN floor(median(gap)) BETWEEN 25 AND 32 THEN 'M' WHEN floor(median(gap)) BETWEEN 85 AND 95 THEN 'Q' ELSE 'D' END AS freq
    FROM (SELECT {key}, datediff('day', lag(d) OVER (PARTITION BY {key} ORDER BY d), d) AS gap FROM ({source})) WHERE gap IS NOT NULL GROUP BY 1"""


@query("f06_infer_frequency_month", _frequency_sql("o_orderpriority", f"SELECT o_orderpriority, ts AS d FROM ({MONTHLY})"))
def infer_frequency_month(spark, sf_dir):
    return ts.infer_frequency(_monthly(spark, sf_dir), ["o_orderpriority"], "ts")


@query("f06_infer_frequency_raw", _frequency_sql("o_custkey", "SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders"))
def infer_frequency_raw(spark, sf_dir):
    return ts.infer_frequency(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")


_AHEAD_DAYS = "(SELECT event_type, (max(ts) + k::INTEGER)::DATE AS ts, k::INTEGER AS step FROM daily, range(1, 11) AS r(k) GROUP BY event_type, k)"


@query("f07_future_dates", f"WITH daily AS ({DAILY}) SELECT * FROM {_AHEAD_DAYS}")
def future_dates(spark, sf_dir):
    return ts.future_dates(_daily(spark, sf_dir), ["event_type"], "D", 10)


@query(
    "f07_future_months",
    """SELECT o_orderpriority, last_day((m + to_months(k::INTEGER))::DATE) AS ts, k::INTEGER AS step FROM (SELECT o_orderpriority, date_trunc('month', max(o_orderdate)) AS m FROM orders GROUP BY 1), range(1, 7) AS r(k)""",
)
def future_months(spark, sf_dir):
    return ts.future_dates(_monthly(spark, sf_dir), ["o_orderpriority"], "M", 6)


def _flat_sql(fitted: str) -> str:
    return f"""WITH daily AS ({DAILY}), f AS ({fitted}), last AS (SELECT event_type, max_by(fitted, ts) AS fitted FROM f GROUP BY 1)
    SELECT event_type, ts, round(value, 4) AS value, round(fitted, 4) AS fitted, 'history' AS kind FROM f
    UNION ALL SELECT a.event_type, a.ts, NULL, round(last.fitted, 4), 'forecast' FROM {_AHEAD_DAYS} a JOIN last USING (event_type)"""


@query(
    "f08_forecast_moving_average",
    _flat_sql(
        """SELECT *, CASE WHEN count(*) OVER w = 3 THEN avg(value) OVER w END AS fitted FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
    ),
)
def forecast_moving_average(spark, sf_dir):
    return rounded(ts.forecast_sma(_daily(spark, sf_dir), ["event_type"], "D"), 4)


@query(
    "f09_forecast_exponential_mean",
    _flat_sql(
        """SELECT a.event_type, a.ts, any_value(a.value) AS value, sum(b.value * pow(0.7, datediff('day', b.ts, a.ts))) / sum(pow(0.7, datediff('day', b.ts, a.ts))) AS fitted
        FROM daily a JOIN daily b ON a.event_type = b.event_type AND b.ts <= a.ts GROUP BY 1, 2"""
    ),
)
def forecast_exponential_mean(spark, sf_dir):
    return rounded(ts.forecast_ema(_daily(spark, sf_dir), ["event_type"], "D"), 4)


@query(
    "f10_forecast_linear",
    f"""WITH daily AS ({DAILY}), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM daily),
    l AS (SELECT event_type, regr_slope(value, i) AS s, regr_intercept(value, i) AS c, max(i) AS z FROM n GROUP BY 1)
    SELECT event_type, ts, round(value, 4) AS value, round(s * i + c, 4) AS fitted, 'history' AS kind FROM n JOIN l USING (event_type)
    UNION ALL SELECT a.event_type, a.ts, NULL, round(s * (z + step) + c, 4), 'forecast' FROM {_AHEAD_DAYS} a JOIN l USING (event_type)""",
)
def forecast_linear(spark, sf_dir):
    return rounded(ts.forecast_linear(_daily(spark, sf_dir), ["event_type"], "D"), 4)


@query("f11_forecast_seasonal_smoothing")
def forecast_seasonal_smoothing(spark, sf_dir):
    return rounded(forecast.forecast_holt_winters(_monthly(spark, sf_dir), ["o_orderpriority"], "M", 12), 4)


@query(
    "f01_resample_hour_mean",
    """SELECT s.event_type, s.ts, round(a.v, 6) AS value FROM (SELECT event_type, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS ts FROM events GROUP BY 1) s
    LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY ALL) a ON a.event_type = s.event_type AND a.ts = s.ts""",
)
def resample_hour_mean(spark, sf_dir):
    return rounded(ts.resample(_events(spark, sf_dir), ["event_type"], "ts", "value", "H", "mean"))


@query("f12_forecast_daily_cycle")
def forecast_daily_cycle(spark, sf_dir):
    hourly = ts.resample(_events(spark, sf_dir), ["event_type"], "ts", "value", "H", "sum")
    return rounded(forecast.forecast_fourier(hourly, ["event_type"], "H", 24, "daily"), 4)


@query("f12_forecast_trend_seasonality")
def forecast_trend_seasonality(spark, sf_dir):
    return rounded(forecast.forecast_fourier(_monthly(spark, sf_dir), ["o_orderpriority"], "M", 12, "yearly"), 4)


@query("f13_forecast_autoregressive")
def forecast_autoregressive(spark, sf_dir):
    return rounded(forecast.forecast_autoregressive(_monthly(spark, sf_dir), ["o_orderpriority"], "M", 12, season=12), 4)


# --- accuracy ----------------------------------------------------------------------------


def _sales(spark, sf_dir):
    """Actual quantity against a naive forecast; 0 and NULL forecasts occur."""
    li = table(spark, sf_dir, "lineitem")
    naive = (
        F.when(F.col("l_linenumber") == 7, None)
        .when(F.col("l_orderkey") % 101 == 0, 0.0)
        .otherwise(F.col("l_suppkey") % 37 + 7.0)
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("actual"), naive.alias("forecast"))


SALES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS actual, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_orderkey % 101 = 0 THEN 0.0::DOUBLE ELSE l_suppkey % 37 + 7.0::DOUBLE END AS forecast FROM lineitem)"""
ERRORS = f"""(SELECT *, actual - forecast AS e, CASE WHEN forecast <> 0 THEN actual / forecast END AS af, CASE WHEN forecast <> 0 THEN abs((actual - forecast) / forecast * 100) END AS ape FROM {SALES} WHERE actual IS NOT NULL AND forecast IS NOT NULL)"""


@query(
    "f14_accuracy_rows",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, actual, forecast, round(af, 6) AS af_ratio, e AS error, abs(e) AS abs_error,
    round(CASE WHEN forecast <> 0 THEN e / forecast * 100 END, 6) + 0.0 AS pct_error, round(ape, 6) AS abs_pct_error FROM {ERRORS}""",
)
def accuracy_rows(spark, sf_dir):
    return rounded(ts.accuracy_rows(_sales(spark, sf_dir), "actual", "forecast"))


@query(
    "f15_accuracy_by_product",
    f"""SELECT l_partkey, round(sum(actual), 2) AS demand, round(sum(forecast), 2) AS forecast, round(avg(af), 4) AS af_ratio, round(sum(e), 2) + 0.0 AS error, round(sum(abs(e)), 2) AS abs_error, round(avg(ape), 4) AS mape FROM {ERRORS} GROUP BY 1""",
)
def accuracy_by_product(spark, sf_dir):
    return rounded(ts.accuracy_by(_sales(spark, sf_dir), ["l_partkey"], "actual", "forecast", digits=4), 4)


@query(
    "f16_accuracy_overall",
    f"""SELECT round(sum(actual), 4) AS total_demand, round(sum(forecast), 4) AS total_forecast, round(sum(actual) / sum(forecast), 6) AS overall_af, round(avg(abs(e)), 6) AS mae,
    round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(ape), 6) AS mape FROM {ERRORS}""",
)
def accuracy_overall(spark, sf_dir):
    return rounded(ts.accuracy_overall(_sales(spark, sf_dir), "actual", "forecast"))


@query(
    "f17_aggregation_error",
    f"""SELECT CASE WHEN grouping(store) = 1 THEN 'Total' ELSE store::VARCHAR END AS store, sum(actual) AS actual, sum(forecast) AS forecast, abs(sum(actual) - sum(forecast)) AS abs_error,
    round(abs(sum(actual) - sum(forecast)) / sum(forecast) * 100, 1) AS error_pct FROM (SELECT l_suppkey AS store, l_quantity AS actual, l_suppkey % 37 + 7.0::DOUBLE AS forecast FROM lineitem) GROUP BY ROLLUP (store)""",
)
def aggregation_error(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("store"), F.col("l_quantity").alias("actual"), (F.col("l_suppkey") % 37 + 7.0).alias("forecast"))
    return ts.aggregation_error(li, "store", "actual", "forecast")


@query(
    "f18_forecast_summary",
    f"""WITH daily AS ({DAILY}), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM daily),
    l AS (SELECT event_type, regr_slope(value, i) AS s, regr_intercept(value, i) AS c, max(i) AS z FROM n GROUP BY 1),
    f AS (SELECT s * (z + step) + c AS fitted FROM {_AHEAD_DAYS} a JOIN l USING (event_type))
    SELECT 'fitted' AS "column", count(fitted) AS "count", round(avg(fitted), 4) AS mean, round(stddev_samp(fitted), 4) AS std, round(min(fitted), 4) AS min, round(max(fitted), 4) AS max,
    round(quantile_cont(fitted, 0.25), 4) AS q25, round(quantile_cont(fitted, 0.5), 4) AS q50, round(quantile_cont(fitted, 0.75), 4) AS q75 FROM f""",
)
def forecast_summary(spark, sf_dir):
    f = ts.forecast_linear(_daily(spark, sf_dir), ["event_type"], "D").where("kind = 'forecast'")
    return rounded(describe(f, ["fitted"]), 4)
