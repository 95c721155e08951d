"""Queries for scalar transforms, scaling, encoding and binning."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import encode, transform
from sievework.plans.registry import DIRTY_LINEITEM, dirty_lineitem, query, rounded, table


def _balances(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@query(
    "x01_log_shift",
    """WITH m AS (SELECT min(c_acctbal) AS a FROM customer) SELECT c_custkey,
    round(ln(c_acctbal + CASE WHEN a < 0 THEN abs(a) + 1 WHEN a = 0 THEN 1 ELSE 0 END), 6) AS c_acctbal FROM customer, m""",
)
def log_shift(spark, sf_dir):
    return rounded(transform.log_transform(_balances(spark, sf_dir), ["c_acctbal"]))


@query(
    "x02_elementwise",
    """SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS log_bal, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS sqrt_bal,
    round(c_acctbal * c_acctbal, 4) AS square_bal FROM customer""",
)
def elementwise(spark, sf_dir):
    c = _balances(spark, sf_dir)
    for op in ("log", "sqrt", "square"):
        c = transform.elementwise(c, "c_acctbal", op, f"{op}_bal")
    return rounded(c.drop("c_acctbal"), 6, square_bal=4)


@query("x03_signed_root", "SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE sqrt(c_acctbal) END, 6) AS c_acctbal FROM customer")
def signed_root(spark, sf_dir):
    return rounded(transform.root_transform(_balances(spark, sf_dir), ["c_acctbal"]))


@query(
    "x04_standard_scale",
    """WITH s AS (SELECT avg(l_extendedprice) AS a, stddev_pop(l_extendedprice) AS b, avg(l_discount) AS c, stddev_pop(l_discount) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - a) / b, 6) + 0.0 AS l_extendedprice, round((l_discount - c) / d, 6) + 0.0 AS l_discount FROM lineitem, s""",
)
def standard_scale(spark, sf_dir):
    return rounded(transform.scale(_prices(spark, sf_dir), ["l_extendedprice", "l_discount"], "standard"))


@query(
    "x05_minmax_scale",
    """WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_discount) AS c, max(l_discount) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - a) / (b - a), 6) AS l_extendedprice, round((l_discount - c) / (d - c), 6) AS l_discount FROM lineitem, s""",
)
def minmax_scale(spark, sf_dir):
    return rounded(transform.scale(_prices(spark, sf_dir), ["l_extendedprice", "l_discount"], "minmax"))


@query(
    "x06_robust_scale",
    """WITH s AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - q[2]) / (q[3] - q[1]), 6) + 0.0 AS l_extendedprice, l_discount FROM lineitem, s""",
)
def robust_scale(spark, sf_dir):
    return rounded(transform.scale(_prices(spark, sf_dir), ["l_extendedprice"], "robust"))


@query(
    "x07_boxcox_fixed",
    """WITH m AS (SELECT min(c_acctbal) AS a FROM customer), x AS (SELECT c_custkey, c_acctbal + CASE WHEN a <= 0 THEN abs(a) + 1 ELSE 0 END AS v FROM customer, m)
    SELECT c_custkey, round((pow(v, 0.5) - 1) / 0.5, 6) AS c_acctbal FROM x""",
)
def boxcox_fixed(spark, sf_dir):
    return rounded(transform.boxcox_transform(_balances(spark, sf_dir), ["c_acctbal"], {"c_acctbal": 0.5}))


@query("x07_boxcox_fitted")
def boxcox_fitted(spark, sf_dir):
    return rounded(transform.boxcox_transform(_balances(spark, sf_dir), ["c_acctbal"]))


@query(
    "x08_yeo_johnson_fixed",
    """WITH y AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.8) - 1) / 0.8 ELSE -(pow(1 - c_acctbal, 1.2) - 1) / 1.2 END AS v FROM customer),
    s AS (SELECT avg(v) AS a, stddev_pop(v) AS b FROM y) SELECT c_custkey, round((v - a) / b, 6) + 0.0 AS c_acctbal FROM y, s""",
)
def yeo_johnson_fixed(spark, sf_dir):
    return rounded(transform.yeo_johnson_transform(_balances(spark, sf_dir), ["c_acctbal"], {"c_acctbal": 0.8}))


@query("x08_yeo_johnson_fitted")
def yeo_johnson_fitted(spark, sf_dir):
    return rounded(transform.yeo_johnson_transform(_balances(spark, sf_dir), ["c_acctbal"]))


@query(
    "x09_transform_skewed",
    """WITH p AS (SELECT p_partkey, exp(p_size / 10) AS grown, exp(p_size / 10) - 5 AS shifted, p_size::DOUBLE AS even FROM part),
    m AS (SELECT min(shifted) AS lo FROM p)
    SELECT p_partkey::VARCHAR AS id, round(ln(1 + grown), 6) AS grown, round(ln(1 + shifted + 1 - lo), 6) AS shifted, even FROM p, m""",
)
def transform_skewed(spark, sf_dir):
    grown = F.exp(F.col("p_size") / 10)
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), grown.alias("grown"), (grown - 5).alias("shifted"), F.col("p_size").cast("double").alias("even")
    )
    return rounded(transform.transform_skewed(p, 0.5, "log"))


@query(
    "x10_guarded_scale",
    """WITH s AS (SELECT avg(l_discount) AS c, stddev_pop(l_discount) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_discount - c) / d, 6) + 0.0 AS l_discount FROM lineitem, s""",
)
def guarded_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("string").alias("l_discount"))
    return rounded(transform.scale_guarded(li, ["l_discount"]))


@query(
    "x11_row_combinations",
    f"""SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, 0) + l_discount + l_tax, 6) AS v_sum,
    round((coalesce(l_quantity, 0) + l_discount + l_tax) / (CASE WHEN l_quantity IS NULL THEN 2 ELSE 3 END), 6) AS v_mean,
    greatest(l_quantity, l_discount, l_tax) AS v_max, least(l_quantity, l_discount, l_tax) AS v_min,
    round(coalesce(l_quantity, 1) * l_discount * l_tax, 6) AS v_product FROM {DIRTY_LINEITEM}""",
)
def row_combinations(spark, sf_dir):
    cols = ["l_quantity", "l_discount", "l_tax"]
    li = dirty_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", *cols)
    for op in ("sum", "mean", "max", "min", "product"):
        li = transform.combine_row(li, cols, op, f"v_{op}")
    return rounded(li.drop(*cols))


@query(
    "x12_cube_inverse_zscore",
    """WITH s AS (SELECT avg(l_tax) AS a, stddev_pop(l_tax) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(l_tax * l_tax * l_tax, 9) AS cube, round(CASE WHEN l_tax <> 0 THEN 1 / l_tax END, 6) AS inverse, round((l_tax - a) / b, 6) + 0.0 AS l_tax FROM lineitem, s""",
)
def cube_inverse_zscore(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    li = transform.elementwise(transform.elementwise(li, "l_tax", "cube", "cube"), "l_tax", "inverse", "inverse")
    return rounded(transform.scale(li, ["l_tax"], "standard"), 6, cube=9)


@query(
    "x13_column_arithmetic",
    """SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS plus, round(l_extendedprice - 100, 6) AS minus,
    round(l_extendedprice * l_discount, 4) AS times, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS ratio FROM lineitem""",
)
def column_arithmetic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    li = transform.arithmetic(li, "l_quantity", "+", "l_tax", "plus")
    li = transform.arithmetic(li, "l_extendedprice", "-", 100, "minus")
    li = transform.arithmetic(li, "l_extendedprice", "*", "l_discount", "times")
    li = transform.arithmetic(li, "l_tax", "/", "l_discount", "ratio")
    return rounded(li.select("l_orderkey", "l_linenumber", "plus", "minus", "times", "ratio"), 6, times=4)


@query(
    "x14_date_polynomial_features",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, quarter(o_orderdate)::INTEGER AS o_orderdate_quarter, month(o_orderdate)::INTEGER AS o_orderdate_month,
    day(o_orderdate)::INTEGER AS o_orderdate_day, (dayofweek(o_orderdate) + 1)::INTEGER AS o_orderdate_weekday,
    round(k * k, 6) AS k__k, round(k * t, 6) AS k__t, round(t * t, 6) AS t__t
    FROM (SELECT o_orderkey, o_orderdate, ln(o_custkey + 2) AS k, ln(o_totalprice) AS t FROM orders)""",
)
def date_polynomial_features(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.ln(F.col("o_custkey") + 2).alias("k"), F.ln("o_totalprice").alias("t"))
    return rounded(transform.polynomial_features(transform.date_features(o, "o_orderdate"), ["k", "t"]).drop("o_orderdate", "k", "t"))


@query("x15_formula", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def formula(spark, sf_dir):
    li = transform.formula(table(spark, sf_dir, "lineitem"), "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "charge")
    return rounded(li.select("l_orderkey", "l_linenumber", "charge"))


# --- encoding and binning ----------------------------------------------------------------


@query("e01_label_encode", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_name) - 1)::INTEGER AS code FROM part")
def label_encode(spark, sf_dir):
    return encode.label_encode(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "code").drop("p_name")


@query(
    "e02_one_hot",
    """SELECT o_orderkey, (o_orderstatus = 'O')::INTEGER AS "o_orderstatus_O", (o_orderstatus = 'P')::INTEGER AS "o_orderstatus_P" FROM orders""",
)
def one_hot(spark, sf_dir):
    return encode.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query(
    "e03_one_hot_unknown_zero",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 AND o_orderpriority = '2-HIGH' THEN 1.0::DOUBLE ELSE 0 END AS o_orderpriority_is_1,
    CASE WHEN o_orderkey % 11 <> 0 AND o_orderpriority = '3-MEDIUM' THEN 1.0::DOUBLE ELSE 0 END AS o_orderpriority_is_2 FROM orders""",
)
def one_hot_unknown_zero(spark, sf_dir):
    # Learned where three priorities occur; the other priorities and NULL encode to zeros.
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    seen = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    stage, names = encode.one_hot_stage(seen, ["o_orderpriority"])
    return stage.transform(o).select("o_orderkey", *names)


@query(
    "e04_country_dummies",
    "SELECT c_custkey, " + ", ".join(f'(c_nationkey = {i})::INTEGER AS "country_{i}"' for i in range(25)) + " FROM customer",
)
def country_dummies(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("country"))
    return encode.one_hot(c, "country", drop_first=False)


@query(
    "e05_equal_width_bins",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 5 AS w FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= lo + w THEN 0 WHEN l_extendedprice <= lo + w * 2 THEN 1 WHEN l_extendedprice <= lo + w * 3 THEN 2
    WHEN l_extendedprice <= lo + w * 4 THEN 3 ELSE 4 END AS l_extendedprice_binned FROM lineitem, s""",
)
def equal_width_bins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return encode.equal_width_bins(li, "l_extendedprice", 5).drop("l_extendedprice")


@query(
    "e06_equal_frequency_bins",
    """WITH s AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= q[1] THEN 0 WHEN l_extendedprice <= q[2] THEN 1 WHEN l_extendedprice <= q[3] THEN 2 ELSE 3 END AS l_extendedprice_bin FROM lineitem, s""",
)
def equal_frequency_bins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return encode.quantile_bins(li, "l_extendedprice", 4).drop("l_extendedprice")


@query(
    "e07_custom_bins",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN NULL WHEN c_acctbal < 1000 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS band FROM customer""",
)
def custom_bins(spark, sf_dir):
    return encode.custom_bins(_balances(spark, sf_dir), "c_acctbal", [0, 1000, 5000, 9000], "band").drop("c_acctbal")


_PARTS = """(SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type FROM part)"""


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("p_brand"), "p_type")


@query(
    "e08_group_small",
    f"""WITH t AS (SELECT p_brand FROM {_PARTS} WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
    SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'Other' END AS p_brand, p_type FROM {_PARTS}""",
)
def group_small(spark, sf_dir):
    return encode.group_small_categories(_parts(spark, sf_dir), 10)


@query(
    "e08_group_small_keep_fewer",
    f"""WITH t AS (SELECT p_brand FROM {_PARTS} WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 9)
    SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'Other' END AS p_brand, p_type FROM {_PARTS}""",
)
def group_small_keep_fewer(spark, sf_dir):
    return encode.group_small_categories(_parts(spark, sf_dir), 10, keep=9)


@query(
    "e09_mean_target_encode",
    "SELECT p_partkey, p_brand, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS p_brand_encoded FROM part",
)
def mean_target_encode(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(encode.mean_target_encode(p, "p_brand", "p_retailprice").drop("p_retailprice"))


@query(
    "e10_smoothed_target_encode",
    """WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1), t AS (SELECT avg(p_retailprice) AS prior FROM part)
    SELECT p_partkey, p_brand, round(prior * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + m * (1 / (1 + exp(-(n - 20) / 10.0))), 6) AS p_brand_encoded FROM part JOIN g USING (p_brand), t""",
)
def smoothed_target_encode(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(encode.smoothed_target_encode(p, "p_brand", "p_retailprice").drop("p_retailprice"))


@query(
    "e11_ordinal_encode",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END AS rank FROM orders""",
)
def ordinal_encode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return encode.ordinal_encode(o, "o_orderpriority", ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"], "rank").drop("o_orderpriority")


@query("e12_label_decode", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code, o_orderpriority AS o_orderpriority_decoded FROM orders")
def label_decode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    words = encode.label_dictionary(o, "o_orderpriority")
    return encode.label_decode(encode.label_encode(o, "o_orderpriority", "code").drop("o_orderpriority"), words, "o_orderpriority", "code")
