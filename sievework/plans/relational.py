"""Queries for joins, unions, sorts and windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sievework.functions import scans
from sievework.operators import encode, joins, timeseries as ts
from sievework.operators.customer import add_segment
from sievework.plans.registry import query, rounded, table
from sievework.plans.series import DAILY, MONTHLY, _daily, _monthly


@query("j01_level_lookup", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def level_lookup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return joins.lookup(li, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").drop("p_partkey")


_TOP_PARTS = "(SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > (SELECT count(*) / count(DISTINCT l_partkey) FROM lineitem))"


def _frequent(li):
    counts = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    mean = li.agg(F.count(F.lit(1)) / F.count_distinct("l_partkey")).scalar()
    return counts.where(F.col("n") > mean)


@query("j04_member_rows", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN {_TOP_PARTS}")
def member_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.keep_members(li, _frequent(li), "l_partkey")


@query("j04_other_rows", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN {_TOP_PARTS}")
def other_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.keep_members(li, _frequent(li), "l_partkey", negate=True)


@query("j05_scalar_on_rows", "SELECT o_orderkey, o_orderdate, (SELECT max(o_orderdate) FROM orders) AS latest FROM orders")
def scalar_on_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return joins.with_scalar(o, o, F.max("o_orderdate"), "latest")


@query(
    "j06_row_union_and_dummies",
    """SELECT id, (kind = 'supplier')::INTEGER AS kind_supplier FROM (SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier)""",
)
def row_union_and_dummies(spark, sf_dir):
    both = joins.union_kinds(
        {
            "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")),
            "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")),
        }
    )
    return encode.one_hot(both, "kind")


@query(
    "j07_history_and_forecast",
    f"""WITH m AS ({MONTHLY}) SELECT o_orderpriority, ts, round(value, 6) AS value, 'history' AS kind FROM m
    UNION ALL SELECT o_orderpriority, last_day((date_trunc('month', max(ts)) + to_months(k::INTEGER))::DATE), NULL, 'forecast' FROM m, range(1, 4) AS r(k) GROUP BY o_orderpriority, k""",
)
def history_and_forecast(spark, sf_dir):
    m = _monthly(spark, sf_dir)
    ahead = ts.future_dates(m, ["o_orderpriority"], "M", 3).select("o_orderpriority", "ts", F.lit(None).cast("double").alias("value"))
    return rounded(joins.union_kinds({"history": m, "forecast": ahead}))


@query("j08_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_rows(spark, sf_dir):
    return joins.top_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("j08_bottom_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def bottom_rows(spark, sf_dir):
    return joins.top_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey", ascending=True)


@query("j08_sorted_rows", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def sorted_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query(
    "j09_rolling_lag_smoothed",
    f"""WITH d AS ({DAILY}), s AS (SELECT a.event_type, a.ts, sum(b.value * pow(0.5, datediff('day', b.ts, a.ts))) / sum(pow(0.5, datediff('day', b.ts, a.ts))) AS smoothed
      FROM d a JOIN d b ON a.event_type = b.event_type AND b.ts <= a.ts GROUP BY ALL)
    SELECT d.event_type, d.ts, round(value, 4) AS value, round(CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END, 4) AS rolling,
    round(value - lag(value) OVER (PARTITION BY d.event_type ORDER BY d.ts), 4) + 0.0 AS diff, round(smoothed, 4) AS smoothed FROM d JOIN s ON s.event_type = d.event_type AND s.ts = d.ts
    WINDOW w AS (PARTITION BY d.event_type ORDER BY d.ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_lag_smoothed(spark, sf_dir):
    d = joins.smoothed(_daily(spark, sf_dir), ["event_type"], 0.5)
    return rounded(joins.lag_difference(joins.rolling_mean(d, ["event_type"], 7), ["event_type"]), 4)


@query(
    "j09_raw_series_scan",
    """WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
    s AS (SELECT a.event_id, sum(b.value * pow(0.5, a.i - b.i)) / sum(pow(0.5, a.i - b.i)) AS smoothed FROM e a JOIN e b ON b.i BETWEEN a.i - 80 AND a.i GROUP BY 1)
    SELECT event_id, i AS "position", round(CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END, 4) AS rolling, round(value - lag(value) OVER o, 4) + 0.0 AS diff,
      round(CASE WHEN count(*) OVER c = 7 THEN avg(value) OVER c END, 4) AS centred, round(smoothed, 4) AS smoothed FROM e JOIN s USING (event_id)
    WINDOW o AS (ORDER BY i), w AS (ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), c AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def raw_series_scan(spark, sf_dir):
    """All events as one series, never in one task."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")

    def parts(run):
        before = run.left[-1:] if len(run.left) else np.array([np.nan])
        return {
            "position": run.position + np.arange(len(run.values)),
            "rolling": scans.moving_mean(run, 7),
            "diff": run.values - np.concatenate([before, run.values[:-1]]),
            "centred": scans.centred_mean(run, 7),
            "smoothed": scans.exponential_means(run, 0.5),
        }

    kinds = {"position": "long", "rolling": "double", "diff": "double", "centred": "double", "smoothed": "double"}
    out = scans.scan_series(events, [], "ts", "value", kinds, parts, before=6, after=3, keep=0.5, tie="event_id")
    return rounded(out.drop("ts", "value"), 4)


@query(
    "j10_row_functions",
    """SELECT l_orderkey, l_linenumber, l_linenumber + 6 AS rfm_score, CASE WHEN l_linenumber + 6 >= 13 THEN 'Champions' WHEN l_linenumber + 6 >= 10 THEN 'Loyal Customers' WHEN l_linenumber + 6 >= 7 THEN 'Potential Loyalists'
    WHEN l_linenumber + 6 >= 4 THEN 'At Risk' ELSE 'Lost' END AS segment FROM lineitem""",
)
def row_functions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + 6).alias("rfm_score"))
    return add_segment(li)
