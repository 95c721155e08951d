"""Queries for profiles and statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import profile, stats
from sievework.plans.registry import (
    DIRTY_LINEITEM,
    DIRTY_ORDERS,
    OUTLIER_CUSTOMERS,
    dirty_lineitem,
    dirty_orders,
    outlier_customers,
    query,
    rounded,
    table,
)
from sievework.session import union_rows

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


_LINE_KINDS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


@query(
    "a01_dataset_summary",
    _union(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_missing,
        round((count(*) - count({c})) * 100.0 / count(*), 6) AS pct_missing, count(DISTINCT {c}) AS n_distinct FROM {DIRTY_LINEITEM}"""
        for c, t in _LINE_KINDS.items()
    ),
)
def dataset_summary(spark, sf_dir):
    return rounded(profile.dataset_summary(dirty_lineitem(spark, sf_dir)))


@query(
    "a02_numeric_stats",
    _union(
        f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(median({c}), 6) AS median FROM {DIRTY_LINEITEM}"""
        for c in LINE_NUMBERS
    ),
)
def numeric_stats(spark, sf_dir):
    return rounded(profile.numeric_stats(dirty_lineitem(spark, sf_dir), LINE_NUMBERS))


@query("a03_distinct_counts", _union(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM {DIRTY_ORDERS}""" for c in ("o_custkey", "o_orderpriority", "price_text")))
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(dirty_orders(spark, sf_dir), ["o_custkey", "o_orderpriority", "price_text"])


@query(
    "a04_duplicate_rows",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS n_duplicates
    FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 50 = 0)""",
)
def duplicate_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return profile.duplicate_rows(union_rows([li, li.where(F.col("l_orderkey") % 50 == 0)]))


@query(
    "a05_datetime_stats",
    """SELECT 'ts' AS "column", min(ts)::TIMESTAMP AS min, max(ts)::TIMESTAMP AS max, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::BIGINT AS range_days FROM events""",
)
def datetime_stats(spark, sf_dir):
    return profile.datetime_stats(table(spark, sf_dir, "events"))


@query(
    "a06_column_stats",
    f"""SELECT statistic, value FROM (SELECT count(*)::VARCHAR AS "count", (count(*) - count(o_orderpriority))::VARCHAR AS missing, count(DISTINCT o_orderpriority)::VARCHAR AS "unique" FROM {DIRTY_ORDERS})
    UNPIVOT (value FOR statistic IN ("count", missing, "unique"))""",
)
def column_stats(spark, sf_dir):
    return profile.column_stats(dirty_orders(spark, sf_dir), "o_orderpriority")


@query(
    "a06_top_values",
    "SELECT p_brand AS value, count(*) AS n_rows, round(count(*) * 100.0 / (SELECT count(*) FROM part), 6) AS pct FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
def top_values(spark, sf_dir):
    return rounded(profile.top_values_share(table(spark, sf_dir, "part"), "p_brand", 5))


def _describe_sql(cols, source: str) -> str:
    return _union(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM {source}"""
        for c in cols
    )


@query("a07_describe", _describe_sql(LINE_NUMBERS, DIRTY_LINEITEM))
def describe(spark, sf_dir):
    return rounded(profile.describe(dirty_lineitem(spark, sf_dir), LINE_NUMBERS))


@query(
    "a08_categorical_stats",
    _union(
        f"""SELECT '{c}' AS "column", count(*) AS n_distinct, first(v ORDER BY n DESC, v NULLS LAST) AS top_value, max(n) AS top_count, round(max(n) * 100.0 / sum(n), 6) AS top_pct
        FROM (SELECT {c} AS v, count(*) AS n FROM {DIRTY_ORDERS} GROUP BY 1)"""
        for c in ("o_orderstatus", "o_orderpriority", "price_text")
    ),
)
def categorical_stats(spark, sf_dir):
    return rounded(profile.categorical_stats(dirty_orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority", "price_text"]))


@query(
    "a09_value_counts",
    _union(f"""(SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n_rows FROM part GROUP BY {c} ORDER BY 3 DESC, {c} LIMIT 10)""" for c in ("p_brand", "p_type", "p_size")),
)
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], 10)


@query(
    "a10_frequency_table",
    f"SELECT o_orderpriority AS value, count(*) AS n_rows, round(count(*) * 100.0 / (SELECT count(o_orderpriority) FROM {DIRTY_ORDERS}), 2) AS pct FROM {DIRTY_ORDERS} WHERE o_orderpriority IS NOT NULL GROUP BY 1",
)
def frequency_table(spark, sf_dir):
    return profile.frequency_table(dirty_orders(spark, sf_dir), "o_orderpriority")


@query(
    "a11_pie_shares",
    """SELECT CASE WHEN r <= 7 THEN value ELSE 'Other' END AS value, sum(n)::BIGINT AS n_rows FROM (
    SELECT (p_size % 12)::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, (p_size % 12)::VARCHAR) AS r FROM part GROUP BY p_size % 12) GROUP BY 1""",
)
def pie_shares(spark, sf_dir):
    return profile.pie_shares(table(spark, sf_dir, "part").select((F.col("p_size") % 12).alias("s")), "s")


def _category_sql(order: str) -> str:
    return f"""SELECT CASE WHEN r <= 15 THEN value ELSE 'Other' END AS value, sum(n)::BIGINT AS n_rows FROM (
    SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY {order}) AS r FROM part GROUP BY 1) GROUP BY 1"""


@query("a11_category_distribution", _category_sql("count(*) DESC, p_brand"))
def category_distribution(spark, sf_dir):
    return profile.category_distribution(table(spark, sf_dir, "part"), "p_brand")


@query("a11_category_distribution_rare", _category_sql("count(*), p_brand"))
def category_distribution_rare(spark, sf_dir):
    return profile.category_distribution(table(spark, sf_dir, "part"), "p_brand", "frequency_asc")


@query("a11_category_distribution_az", _category_sql("p_brand"))
def category_distribution_az(spark, sf_dir):
    return profile.category_distribution(table(spark, sf_dir, "part"), "p_brand", "alphabetical")


def _label_sql(s: str) -> str:
    return f"""CASE WHEN {s} > 1 THEN 'Highly right-skewed' WHEN {s} > 0.5 THEN 'Moderately right-skewed' WHEN abs({s}) <= 0.5 THEN 'Approximately symmetric'
    WHEN {s} > -1 THEN 'Moderately left-skewed' ELSE 'Highly left-skewed' END"""


@query(
    "a12_skewness",
    f"""SELECT "column", round(s, 6) + 0.0 AS skewness, {_label_sql('s')} AS interpretation FROM ("""
    + _union(f"""SELECT '{c}' AS "column", skewness({c}) AS s FROM {OUTLIER_CUSTOMERS}""" for c in ("c_acctbal", "c_nationkey"))
    + ")",
)
def skewness(spark, sf_dir):
    return rounded(profile.skewness_table(outlier_customers(spark, sf_dir), ["c_acctbal", "c_nationkey"]))


_CORR = [(a, b) for a in LINE_NUMBERS for b in LINE_NUMBERS]


@query(
    "a13_correlation_matrix",
    "SELECT * FROM ("
    + _union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
        + ("max(1.0::DOUBLE)" if a == b else f"round(corr({a}, {b}), 3) + 0.0")
        + f" AS r FROM {DIRTY_LINEITEM}"
        for a, b in _CORR
    )
    + ")",
)
def correlation_matrix(spark, sf_dir):
    return rounded(profile.correlation_matrix(dirty_lineitem(spark, sf_dir), LINE_NUMBERS), 3)


def _charges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


_CHARGES = "(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"


@query(
    "a14_strong_pairs",
    f"""SELECT * FROM ({_union(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM {_CHARGES}" for a, b in (('l_quantity', 'l_extendedprice'), ('l_quantity', 'net'), ('l_extendedprice', 'net')))}) WHERE abs(r) > 0.7""",
)
def strong_pairs(spark, sf_dir):
    return rounded(profile.strong_pairs(_charges(spark, sf_dir)))


@query(
    "a15_histogram",
    f"""WITH s AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 10 AS w FROM {OUTLIER_CUSTOMERS}),
    c AS (SELECT least(floor((c_acctbal - lo) / w), 9)::INTEGER AS bin, count(*) AS n FROM {OUTLIER_CUSTOMERS}, s GROUP BY 1)
    SELECT r.bin::INTEGER AS bin, round(lo + r.bin * w, 6) AS bin_from, round(lo + (r.bin + 1) * w, 6) AS bin_to, coalesce(n, 0) AS n_rows
    FROM range(10) AS r(bin) LEFT JOIN c ON c.bin = r.bin, s""",
)
def histogram(spark, sf_dir):
    return rounded(profile.histogram(outlier_customers(spark, sf_dir), "c_acctbal", 10))


@query(
    "a16_box_plot",
    """SELECT l_returnflag, q[1] AS min, round(q[2], 6) AS q25, round(q[3], 6) AS median, round(q[4], 6) AS q75, q[5] AS max, round(q[2] - 1.5 * (q[4] - q[2]), 6) AS fence_low, round(q[4] + 1.5 * (q[4] - q[2]), 6) AS fence_high
    FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM lineitem GROUP BY 1)""",
)
def box_plot(spark, sf_dir):
    return rounded(profile.box_plot(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag"))


@query(
    "a17_eda_description",
    _describe_sql(("c_nationkey", "c_acctbal"), OUTLIER_CUSTOMERS),
)
def eda_description(spark, sf_dir):
    return rounded(profile.eda(outlier_customers(spark, sf_dir).drop("c_custkey"))["description"])


_EDA_NUMBERS = {"c_nationkey": "c_nationkey", "c_acctbal": "c_acctbal"}


def _eda_sql() -> str:
    src = OUTLIER_CUSTOMERS
    parts = [
        f"SELECT 'shape' AS section, 'table' AS name, 'n_rows' AS metric, count(*)::DOUBLE AS value FROM {src}",
        "SELECT 'shape', 'table', 'n_columns', 3",
        "SELECT 'missing', 'table', 'missing_cells', 0",
        "SELECT 'missing', 'table', 'pct_missing', 0",
        f"SELECT 'cardinality', 'c_mktsegment', 'n_distinct', count(DISTINCT c_mktsegment) FROM {src}",
    ]
    for c in _EDA_NUMBERS:
        for m, e in (
            ("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"),
            ("q25", f"quantile_cont({c}, 0.25)"), ("q50", f"quantile_cont({c}, 0.5)"), ("q75", f"quantile_cont({c}, 0.75)"),
        ):
            parts.append(f"SELECT 'description', '{c}', '{m}', {e} FROM {src}")
        parts.append(f"SELECT 'skewed', '{c}', 'skewness', s FROM (SELECT skewness({c}) AS s FROM {src}) WHERE abs(s) > 1")
        fence = f"(SELECT {c} AS v FROM {src}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}) WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
        for m, e in (("n_outliers", "count(*)"), ("pct_outliers", f"count(*) * 100.0 / (SELECT count(*) FROM {src})"), ("min_outlier", "min(v)"), ("max_outlier", "max(v)")):
            parts.append(f"SELECT 'outliers', '{c}', '{m}', {e} FROM {fence} HAVING count(*) > 0")
    return f"SELECT section, name, metric, round(value, 4) + 0.0 AS value FROM ({_union(parts)})"


@query("a18_automated_eda", _eda_sql())
def automated_eda(spark, sf_dir):
    return rounded(profile.eda_metrics(outlier_customers(spark, sf_dir).drop("c_custkey")), 4)


@query(
    "a19_date_analysis",
    """SELECT 'o_orderdate' AS "column", min(o_orderdate)::TIMESTAMP AS min, max(o_orderdate)::TIMESTAMP AS max, datediff('day', min(o_orderdate), max(o_orderdate)) AS range_days,
    count(*) FILTER (dayofweek(o_orderdate) IN (0, 6)) AS weekend_rows, count(*) FILTER (dayofweek(o_orderdate) BETWEEN 1 AND 5) AS weekday_rows, count(*) - count(o_orderdate) AS n_missing FROM orders""",
)
def date_analysis(spark, sf_dir):
    return profile.date_analysis(table(spark, sf_dir, "orders"))


@query(
    "a20_insights",
    f"""SELECT * FROM (SELECT 'columns with missing values' AS finding, (SELECT CASE WHEN count(*) > count(o_orderpriority) THEN 1 ELSE 0 END FROM {DIRTY_ORDERS})::BIGINT AS n, 'fill or drop missing values' AS recommendation
    UNION ALL SELECT 'strongly skewed numeric columns', (SELECT (abs(skewness(o_orderkey)) > 1)::BIGINT + (abs(skewness(o_custkey)) > 1)::BIGINT + (abs(skewness(o_totalprice)) > 1)::BIGINT FROM {DIRTY_ORDERS}), 'transform skewed columns (log, power)'
    UNION ALL SELECT 'strongly correlated pairs', (SELECT (abs(corr(o_orderkey, o_custkey)) > 0.7)::BIGINT + (abs(corr(o_orderkey, o_totalprice)) > 0.7)::BIGINT + (abs(corr(o_custkey, o_totalprice)) > 0.7)::BIGINT FROM {DIRTY_ORDERS}), 'select features or reduce dimensions'
    UNION ALL SELECT 'columns with more than 10 categories', (SELECT (count(DISTINCT o_orderstatus) > 10)::BIGINT + (count(DISTINCT o_orderpriority) > 10)::BIGINT + (count(DISTINCT price_text) > 10)::BIGINT + (count(DISTINCT date_text) > 10)::BIGINT FROM {DIRTY_ORDERS}), 'group or encode wide categories')
    WHERE n > 0""",
)
def insights(spark, sf_dir):
    return profile.insights(dirty_orders(spark, sf_dir))


@query(
    "a21_trend_line",
    """SELECT l_returnflag AS category, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""",
)
def trend_line(spark, sf_dir):
    return rounded(profile.trend_line(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), 6, intercept=4)


@query(
    "a22_contingency",
    f"""SELECT a.o_orderstatus, b.o_orderpriority, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM {DIRTY_ORDERS} WHERE o_orderpriority IS NOT NULL) b
    LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {DIRTY_ORDERS} GROUP BY ALL) c ON a.o_orderstatus = c.o_orderstatus AND b.o_orderpriority = c.o_orderpriority""",
)
def contingency(spark, sf_dir):
    return profile.contingency_grid(dirty_orders(spark, sf_dir), "o_orderstatus", "o_orderpriority")


@query(
    "a22_contingency_many_levels",
    """SELECT l_partkey, l_suppkey, count(*) AS n, any_value(r) AS n_row, any_value(c) AS n_col FROM (SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_partkey) AS r, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem) GROUP BY ALL""",
)
def contingency_many_levels(spark, sf_dir):
    return profile.contingency(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("a23_target_preview", "SELECT o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def target_preview(spark, sf_dir):
    return profile.target_preview(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "a24_column_profile",
    """SELECT 'p_size' AS "column", round(avg(p_size), 6) AS mean, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, (SELECT string_agg(v::VARCHAR, ', ' ORDER BY v) FROM (SELECT DISTINCT p_size AS v FROM part ORDER BY 1 LIMIT 3)) AS samples,
    count(DISTINCT p_size) / count(*) > 0.95 AS is_id, round(count(DISTINCT p_size) / count(*), 6) AS unique_ratio FROM part
    UNION ALL SELECT 'p_partkey', round(avg(p_partkey), 6), min(p_partkey), max(p_partkey), (SELECT string_agg(v::VARCHAR, ', ' ORDER BY v) FROM (SELECT DISTINCT p_partkey AS v FROM part ORDER BY 1 LIMIT 3)), true, 1 FROM part
    UNION ALL SELECT 'p_type', NULL, NULL, NULL, (SELECT string_agg(v::VARCHAR, ', ' ORDER BY v) FROM (SELECT DISTINCT p_type AS v FROM part ORDER BY 1 LIMIT 3)), false, round(count(DISTINCT p_type) / count(*), 6) FROM part""",
)
def column_profile(spark, sf_dir):
    return rounded(profile.column_profile(table(spark, sf_dir, "part"), ["p_size", "p_partkey", "p_type"]))


@query("a25_bar_chart", "SELECT c_mktsegment AS x, round(avg(c_acctbal), 6) AS y FROM customer GROUP BY 1")
def bar_chart(spark, sf_dir):
    return rounded(profile.bar_chart(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "mean"))


@query("a25_line_chart", "SELECT o_orderdate AS x, o_totalprice AS y FROM orders")
def line_chart(spark, sf_dir):
    return profile.line_chart(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


# --- tests -------------------------------------------------------------------------------
# The p-values of the SQL side integrate the density numerically (Simpson's rule).


def _simpson(density: str, upper: str, steps: int = 20000) -> str:
    """Integral of ``density`` (an expression of x) from 0 to ``upper``."""
    return f"""(SELECT sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * f) * h / 3
    FROM (SELECT i, h, {density} AS f FROM (SELECT i, {upper} / {steps}.0 AS h, {upper} / {steps}.0 * i AS x FROM range({steps + 1}) AS r(i))) GROUP BY h)"""


def _t_p(t: str, dof: str) -> str:
    d = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi()) * pow(1 + x * x / {dof}, -({dof} + 1) / 2.0)"
    return f"1 - 2 * {_simpson(d, f'abs({t})')}"


def _chi_p(v: str, dof: str) -> str:
    d = f"pow(x / 2, {dof} / 2.0 - 1) * exp(-x / 2) / 2 / exp(lgamma({dof} / 2.0))"
    return f"1 - {_simpson(d, v)}"


def _f_p(v: str, d1: str, d2: str) -> str:
    d = f"exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)) * pow({d1} / {d2}, {d1} / 2.0) * pow(x, {d1} / 2.0 - 1) * pow(1 + {d1} * x / {d2}, -({d1} + {d2}) / 2.0)"
    return f"1 - {_simpson(d, v)}"


def _test_sql(name: str, stats_sql: str, p: str, dofs: tuple[str, ...], yes: str, no: str) -> str:
    cols = ", ".join(f"round({d}, 6) AS {d}" for d in dofs)
    return f"""WITH s AS ({stats_sql}), p AS (SELECT *, {p} AS p FROM s)
    SELECT '{name}' AS test_name, round(statistic, 6) + 0.0 AS statistic, {cols}, round(p, 6) + 0.0 AS p_value, CASE WHEN p < 0.05 THEN '{yes}' ELSE '{no}' END AS interpretation FROM p"""


@query(
    "h01_one_sample_t",
    _test_sql(
        "One-sample t-test",
        "SELECT avg(v) / (stddev_samp(v) / sqrt(count(v))) AS statistic, (count(v) - 1)::DOUBLE AS dof FROM (SELECT c_acctbal - 4500 AS v FROM customer)",
        _t_p("statistic", "dof"), ("dof",), "Mean differs from 0", "Mean does not differ from 0",
    ),
)
def one_sample_t(spark, sf_dir):
    return rounded(stats.one_sample_t(table(spark, sf_dir, "customer").select((F.col("c_acctbal") - 4500).alias("v")), "v"))


@query(
    "h02_welch_t",
    _test_sql(
        "Welch t-test",
        """SELECT (ma - mb) / sqrt(va / na + vb / nb) AS statistic, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof
        FROM (SELECT avg(a) AS ma, var_samp(a) AS va, count(a)::DOUBLE AS na, avg(b) AS mb, var_samp(b) AS vb, count(b)::DOUBLE AS nb
              FROM (SELECT CASE WHEN c_nationkey < 12 THEN c_acctbal END AS a, CASE WHEN c_nationkey >= 12 THEN c_acctbal END AS b FROM customer))""",
        _t_p("statistic", "dof"), ("dof",), "Means differ", "No difference between means",
    ),
)
def welch_t(spark, sf_dir):
    bal, nation = F.col("c_acctbal"), F.col("c_nationkey")
    c = table(spark, sf_dir, "customer").select(F.when(nation < 12, bal).alias("a"), F.when(nation >= 12, bal).alias("b"))
    return rounded(stats.welch_t(c, "a", "b"))


def _anova_stats(groups: str) -> str:
    return f"""SELECT (ssb / (k - 1)) / (ssw / (t - k)) AS statistic, (k - 1)::DOUBLE AS dof_between, (t - k)::DOUBLE AS dof_within FROM (
      SELECT sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb, sum((n - 1) * v) AS ssw, count(*) AS k, sum(n) AS t FROM ({groups}))"""


@query(
    "h03_anova",
    _test_sql(
        "ANOVA",
        _anova_stats("SELECT c_mktsegment, count(c_acctbal)::DOUBLE AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1"),
        _f_p("statistic", "dof_between", "dof_within"), ("dof_between", "dof_within"),
        "At least one group mean differs", "No difference between group means",
    ),
)
def anova(spark, sf_dir):
    return rounded(stats.anova(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment"))


@query(
    "h04_anova_pooled",
    _test_sql(
        "ANOVA",
        _anova_stats(
            """SELECT g, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v FROM (SELECT c_mktsegment AS g, unnest([c_acctbal, c_nationkey::DOUBLE]) AS x FROM customer)
            GROUP BY 1 HAVING count(*) > 1 AND var_samp(x) > 0"""
        ),
        _f_p("statistic", "dof_between", "dof_within"), ("dof_between", "dof_within"),
        "At least one group mean differs", "No difference between group means",
    ),
)
def anova_pooled(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_nationkey")
    return rounded(stats.anova_pooled(c, "c_mktsegment"))


@query(
    "h05_chi2_uniform",
    _test_sql(
        "Chi-square goodness of fit",
        """SELECT sum(pow(n - t / k, 2) / (t / k)) AS statistic, (max(k) - 1)::DOUBLE AS dof FROM (
        SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM orders GROUP BY o_orderpriority)""",
        _chi_p("statistic", "dof"), ("dof",), "Distribution is not uniform", "No deviation from a uniform distribution",
    ),
)
def chi2_uniform(spark, sf_dir):
    return rounded(stats.chi2_uniform(table(spark, sf_dir, "orders"), "o_orderpriority"))


def _chi2_cells(a: str, b: str, source: str) -> str:
    return f"""SELECT x.a, y.b, coalesce(n, 0)::DOUBLE AS n, r::DOUBLE * c / t AS e FROM (SELECT {a} AS a, count(*) AS r FROM {source} GROUP BY 1) x
    CROSS JOIN (SELECT {b} AS b, count(*) AS c FROM {source} GROUP BY 1) y CROSS JOIN (SELECT count(*) AS t FROM {source}) z
    LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY ALL) w ON w.a = x.a AND w.b = y.b"""


@query(
    "h06_chi2_independence",
    _test_sql(
        "Chi-square independence",
        f"SELECT sum(pow(n - e, 2) / e) AS statistic, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS dof FROM ({_chi2_cells('o_orderstatus', 'o_orderpriority', 'orders')})",
        _chi_p("statistic", "dof"), ("dof",), "Variables are dependent", "Variables are independent",
    ),
)
def chi2_independence(spark, sf_dir):
    return rounded(stats.chi2_independence(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@query(
    "h06_chi2_independence_2x2",
    f"""SELECT 'Chi-square independence' AS test_name, round(sum(pow(abs(n - e) - least(0.5, abs(n - e)), 2) / e), 6) AS statistic, 1.0::DOUBLE AS dof,
    CASE WHEN sum(pow(abs(n - e) - least(0.5, abs(n - e)), 2) / e) > 3.841458820694124 THEN 'Variables are dependent' ELSE 'Variables are independent' END AS interpretation
    FROM ({_chi2_cells('l_linestatus', "l_returnflag = 'A'", 'lineitem')})""",
)
def chi2_independence_2x2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", F.when(F.col("l_returnflag") == "A", "yes").otherwise("no").alias("returned"))
    return rounded(stats.chi2_independence(li, "l_linestatus", "returned").drop("p_value"))


@query(
    "h06_chi2_independence_many_levels",
    """WITH n AS (SELECT l_partkey AS a, l_orderkey % 1500 AS b, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT a, sum(n) AS nr FROM n GROUP BY a), c AS (SELECT b, sum(n) AS nc FROM n GROUP BY b),
    t AS (SELECT sum(n) AS t FROM n), q AS (SELECT sum(n.n::DOUBLE * n.n / nr / nc) AS q FROM n JOIN r USING (a) JOIN c USING (b))
    SELECT round(t * (q - 1), 4) AS statistic, (((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1))::DOUBLE AS dof FROM t, q""",
)
def chi2_independence_many_levels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") % 1500).alias("b"))
    return rounded(stats.chi2_independence(li, "l_partkey", "b").select("statistic", "dof"), 4)


@query(
    "h07_pearson",
    f"""WITH s AS (SELECT corr(l_quantity, l_discount) AS r, (count(*) FILTER (l_quantity IS NOT NULL AND l_discount IS NOT NULL) - 2)::DOUBLE AS dof FROM {DIRTY_LINEITEM}),
    u AS (SELECT *, r * sqrt(dof / (1 - r * r)) AS t FROM s), p AS (SELECT *, {_t_p('t', 'dof')} AS p FROM u)
    SELECT 'Pearson correlation' AS test_name, round(r, 6) + 0.0 AS statistic, dof, round(p, 6) + 0.0 AS p_value, CASE WHEN p < 0.05 THEN 'Significant correlation' ELSE 'No significant correlation' END AS interpretation,
    CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM p""",
)
def pearson(spark, sf_dir):
    return rounded(stats.pearson(dirty_lineitem(spark, sf_dir), "l_quantity", "l_discount"))
