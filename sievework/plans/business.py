"""Queries for customer value and inventory measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.exprs import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ACKLAM_SPLIT
from sievework.operators import customer as cu
from sievework.operators import inventory as inv
from sievework.operators.timeseries import bucket_label, bucket_start
from sievework.plans.registry import query, rounded, table
from sievework.session import cut_lineage

# --- customer value ----------------------------------------------------------------------


def _rfm(spark, sf_dir):
    return cu.rfm(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


RFM = """(SELECT o_custkey, datediff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS recency, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1)"""
CLV = f"""(SELECT o_custkey, r AS recency, frequency, monetary, monetary / frequency * frequency * (365 / r) AS clv FROM (SELECT *, CASE WHEN recency = 0 THEN 1 ELSE recency END AS r FROM {RFM}))"""


@query("c01_rfm", f"SELECT o_custkey, recency, frequency, round(monetary, 4) AS monetary FROM {RFM}")
def rfm(spark, sf_dir):
    return rounded(_rfm(spark, sf_dir), 4)


@query("c02_simple_clv", f"SELECT o_custkey, recency, frequency, round(monetary, 4) AS monetary, round(clv, 4) AS clv FROM {CLV}")
def simple_clv(spark, sf_dir):
    return rounded(cu.simple_clv(_rfm(spark, sf_dir)), 4)


@query(
    "c03_clv_summary",
    f"""SELECT count(*) AS total_customers, round(avg(clv), 2) AS average_clv, round(sum(monetary), 2) AS total_revenue, round(sum(monetary) / sum(frequency), 4) AS average_order_value FROM {CLV}""",
)
def clv_summary(spark, sf_dir):
    return rounded(cu.clv_summary(cu.simple_clv(_rfm(spark, sf_dir))), 2, average_order_value=4)


def _transactions(spark, sf_dir):
    """Order lines with NULL customers, negative quantities, and country of the customer."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("l_orderkey")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .select(
            F.when(key % 19 != 0, F.col("o_custkey")).alias("customer_id"),
            F.col("o_orderdate").alias("invoice_date"),
            F.when(F.col("l_linenumber") == 5, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
            (F.col("l_extendedprice") / 97).alias("unit_price"),
            F.col("c_nationkey").alias("country"),
        )
    )


TRANSACTIONS = """(SELECT * FROM (SELECT CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS customer_id, o_orderdate AS invoice_date, c_nationkey AS country,
 (CASE WHEN l_linenumber = 5 THEN -l_quantity ELSE l_quantity END) * (l_extendedprice / 97) AS amount
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) WHERE customer_id IS NOT NULL AND amount > 0)"""


def _customers_sql(keys: str) -> str:
    return f"""(SELECT {keys}, sum(amount) AS total_revenue, count(*) AS frequency, min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase, sum(amount) / count(*) AS average_order_value,
    datediff('day', min(invoice_date), max(invoice_date)) AS customer_lifespan, datediff('day', max(invoice_date), (SELECT max(invoice_date) FROM {TRANSACTIONS})) AS recency, sum(amount) AS historical_clv
    FROM {TRANSACTIONS} GROUP BY ALL)"""


CUSTOMERS = _customers_sql("customer_id")


def _customers(spark, sf_dir, country=None):
    """Written once: scores and descriptions read the reduced table several times."""
    t = cu.customer_table(_transactions(spark, sf_dir), "customer_id", "invoice_date", "quantity", "unit_price", country)
    return cut_lineage(t)


@query(
    "c04_customer_table",
    f"""SELECT customer_id, country, round(total_revenue, 4) AS total_revenue, frequency, first_purchase, last_purchase, round(average_order_value, 4) AS average_order_value, customer_lifespan, recency, round(historical_clv, 4) AS historical_clv FROM {_customers_sql('customer_id, country')}""",
)
def customer_table(spark, sf_dir):
    return rounded(_customers(spark, sf_dir, "country"), 4)


SCORED = f"""(SELECT *, recency_score + frequency_score + monetary_score AS rfm_score FROM (SELECT c.*,
 CASE WHEN recency <= r[2] THEN 5 WHEN recency <= r[3] THEN 4 WHEN recency <= r[4] THEN 3 WHEN recency <= r[5] THEN 2 ELSE 1 END AS recency_score,
 CASE WHEN frequency <= f[2] THEN 1 WHEN frequency <= f[3] THEN 2 WHEN frequency <= f[4] THEN 3 WHEN frequency <= f[5] THEN 4 ELSE 5 END AS frequency_score,
 CASE WHEN total_revenue <= m[2] THEN 1 WHEN total_revenue <= m[3] THEN 2 WHEN total_revenue <= m[4] THEN 3 WHEN total_revenue <= m[5] THEN 4 ELSE 5 END AS monetary_score
 FROM {CUSTOMERS} c, (SELECT quantile_cont(recency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS r, quantile_cont(frequency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS f,
 quantile_cont(total_revenue, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS m FROM {CUSTOMERS})))"""
SEGMENT = "CASE WHEN rfm_score >= 13 THEN 'Champions' WHEN rfm_score >= 10 THEN 'Loyal Customers' WHEN rfm_score >= 7 THEN 'Potential Loyalists' WHEN rfm_score >= 4 THEN 'At Risk' ELSE 'Lost' END"


@query("c05_rfm_scores", f"SELECT customer_id, recency_score, frequency_score, monetary_score, rfm_score FROM {SCORED}")
def rfm_scores(spark, sf_dir):
    scored = cu.score_rfm(_customers(spark, sf_dir))
    return scored.select("customer_id", "recency_score", "frequency_score", "monetary_score", "rfm_score")


@query("c06_customer_segments", f"SELECT customer_id, recency, frequency, round(total_revenue, 4) AS total_revenue, rfm_score, {SEGMENT} AS segment FROM {SCORED}")
def customer_segments(spark, sf_dir):
    seg = cu.add_segment(cu.score_rfm(_customers(spark, sf_dir)))
    return rounded(seg.select("customer_id", "recency", "frequency", "total_revenue", "rfm_score", "segment"), 4)


@query(
    "c07_segment_stats",
    f"""SELECT segment, round(avg(historical_clv), 2) AS average_clv, round(median(historical_clv), 2) AS median_clv, round(sum(historical_clv), 2) AS total_clv, count(*) AS customer_count,
    round(avg(frequency), 2) AS average_frequency, round(avg(recency), 2) AS average_recency_days, round(sum(total_revenue), 2) AS total_revenue FROM (SELECT *, {SEGMENT} AS segment FROM {SCORED}) GROUP BY 1""",
)
def segment_stats(spark, sf_dir):
    return cu.segment_stats(cu.add_segment(cu.score_rfm(_customers(spark, sf_dir))))


_CLV_COLUMNS = ["historical_clv", "average_order_value", "frequency", "customer_lifespan", "recency"]


@query(
    "c08_clv_description",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75 FROM {CUSTOMERS}"""
        for c in _CLV_COLUMNS
    ),
)
def clv_description(spark, sf_dir):
    return rounded(cu.clv_description(_customers(spark, sf_dir)), 4)


@query(
    "c09_regression_features",
    f"""SELECT customer_id, round(historical_clv, 4) AS historical_clv, frequency::DOUBLE AS frequency, round(average_order_value, 4) AS average_order_value, customer_lifespan::DOUBLE AS customer_lifespan, recency::DOUBLE AS recency,
    datediff('day', first_purchase, TIMESTAMP '2002-01-01')::DOUBLE AS days_since_first_purchase, datediff('day', last_purchase, TIMESTAMP '2002-01-01')::DOUBLE AS days_since_last_purchase, """
    + ", ".join(f'(country = {i})::INTEGER AS "country_{i}"' for i in range(25))
    + f" FROM {_customers_sql('customer_id, country')}",
)
def regression_features(spark, sf_dir):
    return rounded(cu.regression_features(_customers(spark, sf_dir, "country"), "2002-01-01 00:00:00", "country"), 4)


@query("c11_top_customers", f"SELECT o_custkey, recency, frequency, round(monetary, 4) AS monetary, round(clv, 4) AS clv FROM (SELECT * FROM {CLV} ORDER BY clv DESC, o_custkey LIMIT 10)")
def top_customers(spark, sf_dir):
    return rounded(cu.top_customers(cu.simple_clv(_rfm(spark, sf_dir)), "o_custkey", 10), 4)


# --- inventory: an item is a part, demand is the quantity sold ---------------------------


def _items(spark, sf_dir):
    """Yearly demand and unit cost per part, for parts that were sold."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    sold = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("annual_demand"), F.sum("l_extendedprice").alias("annual_sales"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return sold.join(p, sold.l_partkey == p.p_partkey).select(
        "p_partkey", "annual_demand", "annual_sales", F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * 0.6).alias("unit_cost")
    )


ITEMS = """(SELECT p_partkey, annual_demand, annual_sales, p_retailprice AS price, p_retailprice * 0.6 AS unit_cost
 FROM (SELECT l_partkey, sum(l_quantity) AS annual_demand, sum(l_extendedprice) AS annual_sales FROM lineitem GROUP BY 1) JOIN part ON p_partkey = l_partkey)"""


def _weekly(spark, sf_dir):
    """Observed demand per part and week."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    week = bucket_label(bucket_start("l_shipdate", "W"), "W")
    return li.groupBy("l_partkey", week.alias("week")).agg(F.sum("l_quantity").alias("demand"))


WEEKLY = "(SELECT l_partkey, date_trunc('week', l_shipdate) AS week, sum(l_quantity) AS demand FROM lineitem GROUP BY ALL)"


@query("v01_economic_order_quantity", f"SELECT p_partkey, round(sqrt(2 * annual_demand * 500 / (unit_cost * 0.2)), 6) AS eoq FROM {ITEMS}")
def economic_order_quantity(spark, sf_dir):
    items = inv.economic_order_quantity(_items(spark, sf_dir), "annual_demand", 500, "unit_cost", 0.2)
    return rounded(items.select("p_partkey", "eoq"))


@query(
    "v02_order_size_costs",
    f"""SELECT p_partkey, round(annual_demand / 50, 6) AS num_orders, round(annual_demand / 50 * 500, 4) AS order_cost, round(25 * unit_cost * 0.2, 4) AS holding_cost, round(annual_demand / 50 * 500 + 25 * unit_cost * 0.2, 4) AS total_cost FROM {ITEMS}""",
)
def order_size_costs(spark, sf_dir):
    costs = inv.order_size_costs(_items(spark, sf_dir), 50, "annual_demand", 500, "unit_cost", 0.2)
    return rounded(costs.select("p_partkey", "num_orders", "order_cost", "holding_cost", "total_cost"), 4, num_orders=6)


@query(
    "v03_cost_curve",
    f"""SELECT p_partkey, step::INTEGER AS step, round(q, 4) AS order_size, round(annual_demand / q * 500, 4) AS order_cost, round(q / 2 * (unit_cost * 0.2), 4) AS holding_cost, round(annual_demand / q * 500 + q / 2 * (unit_cost * 0.2), 4) AS total_cost
    FROM (SELECT *, sqrt(2 * annual_demand * 500 / (unit_cost * 0.2)) * (0.5 + step * 0.1) AS q FROM {ITEMS}, range(20) AS r(step))""",
)
def cost_curve(spark, sf_dir):
    return rounded(inv.cost_curve(_items(spark, sf_dir), ["p_partkey"], "annual_demand", 500, "unit_cost", 0.2), 4)


@query(
    "v04_inventory_sawtooth",
    f"""SELECT p_partkey, step::INTEGER AS step, step * 0.5::DOUBLE AS month, round(greatest(0, 60 - ((step * 0.5::DOUBLE) % (60 / (annual_demand / 12))) * (annual_demand / 12)), 4) AS inventory FROM {ITEMS}, range(25) AS r(step)""",
)
def inventory_sawtooth(spark, sf_dir):
    return rounded(inv.inventory_sawtooth(_items(spark, sf_dir), ["p_partkey"], 60, "annual_demand"), 4)


def _horner_sql(coefficients, x: str) -> str:
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c})"
    return out


def _z_sql(p: str) -> str:
    tail = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"{_horner_sql(ACKLAM_C, tail)} / {_horner_sql((*ACKLAM_D, 1.0), tail)}"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    middle = f"{_horner_sql(ACKLAM_A, r)} * ({p} - 0.5) / {_horner_sql((*ACKLAM_B, 1.0), r)}"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {ACKLAM_SPLIT} THEN {outer} WHEN {p} <= {1 - ACKLAM_SPLIT} THEN {middle} ELSE -({outer}) END)"


def _spread(spark, sf_dir):
    w = _weekly(spark, sf_dir)
    return w.groupBy("l_partkey").agg(F.avg("demand").alias("mu"), F.stddev_samp("demand").alias("sigma"))


SPREAD = f"(SELECT l_partkey, avg(demand) AS mu, stddev_samp(demand) AS sigma FROM {WEEKLY} GROUP BY 1)"
Z95 = 1.6448536269514715


@query(
    "v05_safety_stock",
    f"""SELECT l_partkey, round({Z95} * sigma * sqrt(2.0), 6) AS safety_stock, round({_z_sql('level')} * sigma * sqrt(2.0), 6) AS item_safety_stock FROM (SELECT *, 0.80::DOUBLE + (l_partkey % 20) / 100 AS level FROM {SPREAD})""",
)
def safety_stock(spark, sf_dir):
    s = _spread(spark, sf_dir).withColumn("level", 0.80 + (F.col("l_partkey") % 20) / 100)
    s = inv.safety_stock(inv.safety_stock(s, "sigma", 2, 0.95), "sigma", 2, "level", "item_safety_stock")
    return rounded(s.select("l_partkey", "safety_stock", "item_safety_stock"))


@query(
    "v06_reorder_policy",
    f"""SELECT p_partkey, round(eoq, 4) AS eoq, round(ss, 4) AS safety_stock, round(annual_demand / 365 * 7 + ss, 4) AS reorder_point, round(eoq / 2 + ss, 4) AS avg_inventory, round((eoq / 2 + ss) * unit_cost * 0.25, 4) AS annual_holding_cost,
    round(annual_demand / eoq * 500, 4) AS annual_order_cost, round((eoq / 2 + ss) * unit_cost * 0.25 + annual_demand / eoq * 500, 4) AS total_annual_cost
    FROM (SELECT *, sqrt(2 * annual_demand * 500 / (unit_cost * 0.25)) AS eoq, {Z95} * (annual_demand / 365) * 0.2 * sqrt(7.0) AS ss FROM {ITEMS})""",
)
def reorder_policy(spark, sf_dir):
    p = inv.reorder_policy(_items(spark, sf_dir), "annual_demand", 500, "unit_cost", 0.25, 7, 0.95)
    return rounded(p.drop("annual_demand", "annual_sales", "price", "unit_cost"), 4)


@query(
    "v07_turnover",
    f"""SELECT p_partkey, round(v * 0.08, 4) AS physical_holding_cost, round(v * 0.05, 4) AS financial_holding_cost, round(v * 0.08 + v * 0.05, 4) AS total_holding_cost, round(cogs / v, 6) AS inventory_turnover,
    round(365 / (cogs / v), 4) AS days_inventory, round(annual_sales / (v + 500), 6) AS asset_turnover, round(cogs + 500 + v * 0.08 + v * 0.05, 2) AS total_inventory_cost
    FROM (SELECT *, price * 20 AS v, unit_cost * annual_demand AS cogs FROM {ITEMS})""",
)
def turnover(spark, sf_dir):
    cogs = F.col("unit_cost") * F.col("annual_demand")
    t = inv.turnover(_items(spark, sf_dir), cogs, 500, 8, 5, F.col("price") * 20, "annual_sales", cogs)
    return rounded(
        t.drop("annual_demand", "annual_sales", "price", "unit_cost"), 4, inventory_turnover=6, asset_turnover=6, total_inventory_cost=2
    )


@query(
    "v08_stockout_replay",
    f"""SELECT l_partkey, round(max(lvl), 6) AS stock_level, count(*) AS periods, count(*) FILTER (demand > lvl) AS stock_outs, floor(sum(greatest(demand - lvl, 0)))::BIGINT AS lost_units, round(sum(greatest(demand - lvl, 0)) * 4, 4) AS lost_profit,
    round(sum(greatest(lvl - demand, 0)) / count(*), 6) AS avg_excess, round(sum(greatest(lvl - demand, 0)) / count(*) * 0.02 * count(*), 6) AS holding_cost,
    CASE WHEN count(*) FILTER (demand > lvl) / count(*) > 0.05 THEN 'Raise Service' WHEN count(*) FILTER (demand > lvl) / count(*) < 0.02 THEN 'Lower Service' ELSE 'Maintain Service' END AS action
    FROM {WEEKLY} JOIN (SELECT l_partkey, {Z95} * coalesce(sigma, 0) * sqrt(1.0) + mu AS lvl FROM {SPREAD}) USING (l_partkey) GROUP BY 1""",
)
def stockout_replay(spark, sf_dir):
    return rounded(inv.stockout_replay(_weekly(spark, sf_dir), ["l_partkey"], "demand", 1.0, 0.95, 4.0, 0.02), 6, lost_profit=4)


def _newsvendor_sql(q: str) -> str:
    return f"""SELECT l_partkey, round(cr, 6) AS critical_ratio, round(q, 6) AS optimal_quantity, round(10 * mu, 4) AS expected_sales, round(cost_s * greatest(0, q - mu), 4) + 0.0 AS salvage_revenue, round(cost * q, 4) AS total_cost,
    round(10 * mu + cost_s * greatest(0, q - mu) - cost * q, 4) AS expected_profit FROM (SELECT *, {q} AS q FROM (SELECT *, (10 - cost) / (10 - cost_s) AS cr FROM (SELECT *, 2.0::DOUBLE + (l_partkey % 7) AS cost, 0.5::DOUBLE AS cost_s FROM {SPREAD}))) WHERE q IS NOT NULL"""


def _newsvendor(spark, sf_dir, distribution):
    s = _spread(spark, sf_dir).withColumn("cost", 2.0 + F.col("l_partkey") % 7)
    out = inv.newsvendor(s, "mu", "sigma", "cost", 10, 0.5, distribution).where(F.col("optimal_quantity").isNotNull())
    return rounded(out.drop("mu", "sigma", "cost"), 4, critical_ratio=6, optimal_quantity=6)


@query("v09_newsvendor_normal", _newsvendor_sql(f"mu + sigma * {_z_sql('cr')}"))
def newsvendor_normal(spark, sf_dir):
    return _newsvendor(spark, sf_dir, "normal")


@query("v09_newsvendor_uniform", _newsvendor_sql("mu - sigma * sqrt(3.0) + ((mu + sigma * sqrt(3.0)) - (mu - sigma * sqrt(3.0))) * cr"))
def newsvendor_uniform(spark, sf_dir):
    return _newsvendor(spark, sf_dir, "uniform")


@query(
    "v10_order_profit_replay",
    f"""SELECT l_partkey, count(*) AS periods, round(sum(least(demand, 25) * 10 + greatest(0, 25 - demand) * 2 - 25 * 6), 4) + 0.0 AS your_profit, round(sum(least(demand, mu) * 10 + greatest(0, mu - demand) * 2 - mu * 6), 4) + 0.0 AS optimal_profit,
    round(sum(least(demand, mu) * 10 + greatest(0, mu - demand) * 2 - mu * 6) - sum(least(demand, 25) * 10 + greatest(0, 25 - demand) * 2 - 25 * 6), 4) + 0.0 AS profit_diff FROM {WEEKLY} JOIN {SPREAD} USING (l_partkey) GROUP BY 1""",
)
def order_profit_replay(spark, sf_dir):
    rows = _weekly(spark, sf_dir).join(_spread(spark, sf_dir), "l_partkey")
    return rounded(inv.order_profit_replay(rows, ["l_partkey"], "demand", 25, "mu", 6, 10, 2), 4)


_PRICES = f"""(SELECT *, annual_demand * exp(-2 + 0.5 * ln(price_at / price)) AS quantity, (price_at - unit_cost) * (annual_demand * exp(-2 + 0.5 * ln(price_at / price))) AS profit
 FROM (SELECT *, greatest(0.01, price * 0.1) + step * ((price * 2 - greatest(0.01, price * 0.1)) / 199) AS price_at FROM {ITEMS}, range(200) AS r(step)))"""


@query("v11_price_grid", f"SELECT p_partkey, step::INTEGER AS step, round(price_at, 6) AS price, round(quantity, 6) AS demand, round(profit, 4) AS profit FROM {_PRICES}")
def price_grid(spark, sf_dir):
    return rounded(inv.price_grid(_items(spark, sf_dir), ["p_partkey"], "annual_demand", "price", "unit_cost", -2.0, 0.5), 6, profit=4)


@query(
    "v11_price_optimum",
    f"""SELECT p_partkey, round(max_by(price_at, profit), 6) AS price, round(max_by(quantity, profit), 6) AS quantity, round(max(profit), 4) AS profit, 0.5::DOUBLE AS elasticity FROM {_PRICES} GROUP BY 1""",
)
def price_optimum(spark, sf_dir):
    return rounded(inv.price_optimum(_items(spark, sf_dir), ["p_partkey"], "annual_demand", "price", "unit_cost"), 6, profit=4)


# A trio is three consecutive parts with the quantities sold as base demand.
EFFECTS = ((0.2, 0.2, 0.1), (0.2, 0.3, -0.2), (0.1, -0.2, 0.4))
SPACE = (10, 10, 30)
BASE, MARGIN = ["d0", "d1", "d2"], ["m0", "m1", "m2"]


def _trios(spark, sf_dir):
    items = _items(spark, sf_dir)
    slot = F.col("p_partkey") % 3
    return (
        items.groupBy(F.floor(F.col("p_partkey") / 3).alias("trio"))
        .agg(
            *[F.sum(F.when(slot == i, F.col("annual_demand"))).alias(f"d{i}") for i in range(3)],
            *[F.sum(F.when(slot == i, F.col("price") / 97)).alias(f"m{i}") for i in range(3)],
        )
        .na.drop()
    )


TRIOS = (
    "(SELECT * FROM (SELECT floor(p_partkey / 3)::BIGINT AS trio, "
    + ", ".join(f"sum(annual_demand) FILTER (p_partkey % 3 = {i}) AS d{i}, sum(price / 97) FILTER (p_partkey % 3 = {i}) AS m{i}" for i in range(3))
    + f" FROM {ITEMS} GROUP BY 1) WHERE d0 IS NOT NULL AND d1 IS NOT NULL AND d2 IS NOT NULL)"
)


def _profit_sql(i: int, s: tuple[str, str, str]) -> str:
    return f"(d{i} * " + " * ".join(f"(1 + {EFFECTS[i][j]} * {s[j]})" for j in range(3)) + f" * m{i})"


_S = ("space", "10", "(50 - space - 10)")
_CURVE = f"""(SELECT *, {' , '.join(f'{_profit_sql(i, _S)} AS p{i + 1}' for i in range(3))} FROM (SELECT *, 5 + step * (40.0::DOUBLE / 49) AS space FROM {TRIOS}, range(50) AS r(step)) WHERE 50 - space - 10 >= 5)"""


@query(
    "v12_shelf_space_curve",
    f"SELECT trio, step::INTEGER AS step, round(space, 6) AS space, round(p1, 2) + 0.0 AS p1_profit, round(p2, 2) + 0.0 AS p2_profit, round(p3, 2) + 0.0 AS p3_profit, round(p1 + p2 + p3, 2) + 0.0 AS total_profit FROM {_CURVE}",
)
def shelf_space_curve(spark, sf_dir):
    return rounded(inv.shelf_space_curve(_trios(spark, sf_dir), ["trio"], BASE, MARGIN, SPACE, EFFECTS), 2, space=6)


_NOW = " + ".join(_profit_sql(i, ("10", "10", "30")) for i in range(3))


@query(
    "v12_shelf_space_optimum",
    f"""WITH b AS (SELECT trio, max_by({{'s': space, 't': p1 + p2 + p3, 'p1': p1, 'p2': p2, 'p3': p3}}, p1 + p2 + p3) AS b FROM {_CURVE} GROUP BY 1),
    x AS (SELECT trio, b.s AS s, b.t AS t, b.p1 / b.s AS e1, b.p2 / 10 AS e2, b.p3 / (50 - b.s - 10) AS e3, {_NOW} AS now FROM b JOIN {TRIOS} USING (trio))
    SELECT trio, round(s, 6) AS focus_space, round(50 - s - 10, 6) AS other_space, round(t, 2) AS optimal_profit, round(now, 2) AS current_profit, round(t - now, 2) AS profit_improvement, round(CASE WHEN now > 0 THEN (t - now) / now * 100 ELSE 0 END, 6) AS improvement_pct,
    round(e1, 2) AS p1_profit_per_space, round(e2, 2) AS p2_profit_per_space, round(e3, 2) AS p3_profit_per_space, CASE WHEN e1 >= e2 AND e1 >= e3 THEN 'p1' WHEN e2 >= e3 THEN 'p2' ELSE 'p3' END AS most_efficient FROM x""",
)
def shelf_space_optimum(spark, sf_dir):
    best = inv.shelf_space_optimum(_trios(spark, sf_dir), ["trio"], BASE, MARGIN, SPACE, EFFECTS)
    return rounded(best, 2, focus_space=6, other_space=6, improvement_pct=6)


@query(
    "v12_cross_effects",
    """WITH w AS (SELECT l_returnflag || l_linestatus AS k, month(l_shipdate) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
    p AS (SELECT a.k AS source, b.k AS target, round(corr(a.q, b.q), 6) + 0.0 AS effect FROM w a JOIN w b ON a.m = b.m WHERE a.k <> b.k GROUP BY ALL)
    SELECT source, target, effect, CASE WHEN effect > 0 THEN 'positive' ELSE 'negative' END AS kind, row_number() OVER (PARTITION BY effect > 0 ORDER BY abs(effect) DESC, source, target)::INTEGER AS strength_rank FROM p""",
)
def cross_effects(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    w = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("k"), F.month("l_shipdate").alias("m")).agg(F.sum("l_quantity").alias("q"))
    a = w.select(F.col("k").alias("source"), "m", F.col("q").alias("qa"))
    b = w.select(F.col("k").alias("target"), "m", F.col("q").alias("qb"))
    pairs = a.join(b, "m").where("source <> target").groupBy("source", "target").agg(F.corr("qa", "qb").alias("effect"))
    return inv.cross_effects(rounded(pairs), "source", "target", "effect")
