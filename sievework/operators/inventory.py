"""Inventory policy measures: column arithmetic, one row per item (SKU).

Parameters are columns of the item table or plain numbers; a string names a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.exprs import normal_quantile
from sievework.functions.order_stats import value_slices
from sievework.session import parallelism

Value = str | float | int | Column


def _c(v: Value) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v).cast("double") if isinstance(v, str) else F.lit(float(v))


def eoq_of(demand: Value, order_cost: Value, unit_cost: Value, holding_rate: Value) -> Column:
    return F.sqrt(F.try_divide(2 * _c(demand) * _c(order_cost), _c(unit_cost) * _c(holding_rate)))


def economic_order_quantity(
    df: DataFrame, demand: Value, order_cost: Value, unit_cost: Value, holding_rate: Value
) -> DataFrame:
    return df.withColumn("eoq", eoq_of(demand, order_cost, unit_cost, holding_rate))


def order_size_costs(
    df: DataFrame, size: Value, demand: Value, order_cost: Value, unit_cost: Value, holding_rate: Value
) -> DataFrame:
    """Orders per year, order cost, holding cost and their sum; all 0 where the size is 0."""
    orders = F.try_divide(_c(demand), _c(size))
    ordering = orders * _c(order_cost)
    holding = _c(size) / 2 * _c(unit_cost) * _c(holding_rate)
    ok = orders.isNotNull()
    return df.withColumns(
        {
            "num_orders": F.coalesce(orders, F.lit(0.0)),
            "order_cost": F.coalesce(ordering, F.lit(0.0)),
            "holding_cost": F.when(ok, holding).otherwise(0.0),
            "total_cost": F.when(ok, ordering + holding).otherwise(0.0),
        }
    )


def cost_curve(
    df: DataFrame, keys: Sequence[str], demand: Value, order_cost: Value, unit_cost: Value, holding_rate: Value
) -> DataFrame:
    """Costs at 20 order sizes from .5 to 2.4 times the economic quantity."""
    best = df.select(*keys, eoq_of(demand, order_cost, unit_cost, holding_rate).alias("_q"), _c(demand).alias("_d"), _c(order_cost).alias("_k"), (_c(unit_cost) * _c(holding_rate)).alias("_h"))
    points = best.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn(
        "order_size", F.col("_q") * (0.5 + F.col("step") * 0.1)
    )
    ordering = F.try_divide(F.col("_d"), F.col("order_size")) * F.col("_k")
    holding = F.col("order_size") / 2 * F.col("_h")
    return points.select(*keys, "step", "order_size", ordering.alias("order_cost"), holding.alias("holding_cost"), (ordering + holding).alias("total_cost"))


def inventory_sawtooth(df: DataFrame, keys: Sequence[str], order_size: Value, demand: Value) -> DataFrame:
    """Stock at 25 half-month points when an order arrives as the stock runs out."""
    monthly = _c(demand) / 12
    points = df.select(*keys, _c(order_size).alias("_q"), monthly.alias("_m")).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(24)))
    )
    t = F.col("step") * 0.5
    cycle = F.try_mod(t, F.try_divide(F.col("_q"), F.col("_m")))
    return points.select(
        *keys, "step", t.alias("month"), F.greatest(F.lit(0.0), F.col("_q") - cycle * F.col("_m")).alias("inventory")
    )


def z_value(service_level: float) -> float:
    return NormalDist().inv_cdf(service_level)


def safety_stock(df: DataFrame, sigma: Value, lead_time: Value, service_level: Value, name: str = "safety_stock") -> DataFrame:
    """z(service level) x sigma x sqrt(lead time); a column level uses the rational approximation."""
    z = F.lit(z_value(service_level)) if isinstance(service_level, float) else normal_quantile(_c(service_level))
    return df.withColumn(name, z * _c(sigma) * F.sqrt(_c(lead_time)))


def reorder_policy(
    df: DataFrame,
    demand: Value,
    order_cost: Value,
    unit_cost: Value,
    holding_rate: Value,
    lead_time: Value,
    service_level: float,
    demand_spread: float = 0.2,
) -> DataFrame:
    """EOQ, safety stock (daily spread as a share of daily demand), reorder point, yearly costs."""
    daily = _c(demand) / 365
    q = eoq_of(demand, order_cost, unit_cost, holding_rate)
    safety = F.lit(z_value(service_level)) * daily * demand_spread * F.sqrt(_c(lead_time))
    average = F.col("eoq") / 2 + F.col("safety_stock")
    holding = F.col("avg_inventory") * _c(unit_cost) * _c(holding_rate)
    ordering = F.try_divide(_c(demand), F.col("eoq")) * _c(order_cost)
    return (
        df.withColumn("eoq", q)
        .withColumn("safety_stock", safety)
        .withColumn("reorder_point", daily * _c(lead_time) + F.col("safety_stock"))
        .withColumn("avg_inventory", average)
        .withColumn("annual_holding_cost", holding)
        .withColumn("annual_order_cost", ordering)
        .withColumn("total_annual_cost", F.col("annual_holding_cost") + F.col("annual_order_cost"))
    )


def turnover(
    df: DataFrame,
    purchase_cost: Value,
    order_cost: Value,
    physical_rate: Value,
    financial_rate: Value,
    avg_inventory_value: Value,
    annual_sales: Value,
    cogs: Value,
) -> DataFrame:
    """Holding costs (rates in percent), turnover, days of inventory, asset turnover, total."""
    value = _c(avg_inventory_value)
    turns = F.when(value > 0, _c(cogs) / value).otherwise(0.0)
    base = value + _c(order_cost)
    physical, financial = value * (_c(physical_rate) / 100), value * (_c(financial_rate) / 100)
    return df.withColumns(
        {
            "physical_holding_cost": physical,
            "financial_holding_cost": financial,
            "total_holding_cost": physical + financial,
            "inventory_turnover": turns,
            "days_inventory": F.when(turns > 0, F.try_divide(F.lit(365.0), turns)).otherwise(0.0),
            "asset_turnover": F.when(base > 0, F.try_divide(_c(annual_sales), base)).otherwise(0.0),
            "total_inventory_cost": _c(purchase_cost) + _c(order_cost) + physical + financial,
        }
    )


def stockout_replay(
    demand: DataFrame,
    keys: Sequence[str],
    quantity: str,
    lead_time: float,
    service_level: float,
    unit_profit: float,
    holding_rate: float,
) -> DataFrame:
    """Replay observed demand per period against safety stock + expected demand.

    Expected demand and its deviation are the item's own mean and sample deviation.  The stock
    is restored before each period, so periods are independent and the replay is two
    aggregations: item statistics first, then conditional sums over the periods.
    """
    stats = demand.groupBy(*keys).agg(F.avg(quantity).alias("_mu"), F.coalesce(F.stddev_samp(quantity), F.lit(0.0)).alias("_sd"))
    level = F.lit(z_value(service_level)) * F.col("_sd") * F.sqrt(F.lit(float(lead_time))) + F.col("_mu")
    rows = demand.join(stats.withColumn("stock_level", level).select(*keys, "stock_level"), list(keys))
    d, s = F.col(quantity).cast("double"), F.col("stock_level")
    short = d > s
    out = rows.groupBy(*keys).agg(
        F.max("stock_level").alias("stock_level"),
        F.count(F.lit(1)).alias("periods"),
        F.count_if(short).alias("stock_outs"),
        F.sum(F.when(short, d - s).otherwise(0.0)).alias("_lost"),
        F.sum(F.when(short, 0.0).otherwise(s - d)).alias("_excess"),
    )
    rate = F.col("stock_outs") / F.col("periods")
    avg_excess = F.col("_excess") / F.col("periods")
    return out.select(
        *keys,
        "stock_level",
        "periods",
        "stock_outs",
        F.floor("_lost").cast("bigint").alias("lost_units"),
        (F.col("_lost") * unit_profit).alias("lost_profit"),
        avg_excess.alias("avg_excess"),
        (avg_excess * holding_rate * F.col("periods")).alias("holding_cost"),
        F.when(rate > 0.05, "Raise Service").when(rate < 0.02, "Lower Service").otherwise("Maintain Service").alias("action"),
    )


def newsvendor(
    df: DataFrame, expected: Value, std: Value, cost: Value, price: Value, salvage: Value, distribution: str = "normal"
) -> DataFrame:
    """Critical ratio, optimal quantity and the parts of the expected profit."""
    ratio = F.try_divide(_c(price) - _c(cost), _c(price) - _c(salvage))
    if distribution == "normal":
        q = _c(expected) + _c(std) * normal_quantile(F.col("critical_ratio"))
    else:
        low = _c(expected) - _c(std) * F.sqrt(F.lit(3.0))
        high = _c(expected) + _c(std) * F.sqrt(F.lit(3.0))
        q = low + (high - low) * F.col("critical_ratio")
    over = F.greatest(F.lit(0.0), F.col("optimal_quantity") - _c(expected))
    return (
        df.withColumn("critical_ratio", ratio)
        .withColumn("optimal_quantity", q)
        .withColumn("expected_sales", _c(price) * _c(expected))
        .withColumn("salvage_revenue", F.when(F.col("optimal_quantity").isNotNull(), _c(salvage) * over))
        .withColumn("total_cost", _c(cost) * F.col("optimal_quantity"))
        .withColumn("expected_profit", F.col("expected_sales") + F.col("salvage_revenue") - F.col("total_cost"))
    )


def order_profit_replay(
    demand: DataFrame, keys: Sequence[str], quantity: str, yours: Value, optimal: Value, cost: Value, price: Value, salvage: Value
) -> DataFrame:
    """Profit of two order quantities over the observed demand rows of each item."""
    d = F.col(quantity).cast("double")

    def profit(q: Column) -> Column:
        return F.least(d, q) * _c(price) + F.greatest(F.lit(0.0), q - d) * _c(salvage) - q * _c(cost)

    return demand.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        F.sum(profit(_c(yours))).alias("your_profit"),
        F.sum(profit(_c(optimal))).alias("optimal_profit"),
        (F.sum(profit(_c(optimal))) - F.sum(profit(_c(yours)))).alias("profit_diff"),
    )


def price_grid(df: DataFrame, keys: Sequence[str], base_demand: Value, base_price: Value, unit_cost: Value, a: float, b: float, points: int = 200) -> DataFrame:
    """Demand and profit of every item at evenly spaced prices up to twice the base price."""
    p0 = _c(base_price)
    items = df.select(*keys, _c(base_demand).alias("_d"), p0.alias("_p"), _c(unit_cost).alias("_c"))
    grid = items.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    low = F.greatest(F.lit(0.01), F.col("_p") * 0.1)
    price = low + F.col("step") * ((F.col("_p") * 2 - low) / (points - 1))
    demand = F.col("_d") * F.exp(F.lit(float(a)) + F.lit(float(b)) * F.ln(F.try_divide(F.col("price"), F.col("_p"))))
    return (
        grid.withColumn("price", price)
        .withColumn("demand", demand)
        .withColumn("profit", (F.col("price") - F.col("_c")) * F.col("demand"))
        .select(*keys, "step", "price", "demand", "profit")
    )


def price_optimum(df: DataFrame, keys: Sequence[str], base_demand: Value, base_price: Value, unit_cost: Value, a: float = -2.0, b: float = 0.5, points: int = 200) -> DataFrame:
    """Price of highest profit, the lowest such price on ties: one row per row, without a shuffle.

    Profit is a multiple of (price / p0)^b * (price - cost), which turns only where price is
    b * cost / (b + 1): the best of the grid is one of its ends or beside that turning point (or
    beside price 0, where the curve ends if the base price is negative).
    """
    p0, low = _c(base_price), F.greatest(F.lit(0.01), _c(base_price) * 0.1)

    def point(step: Column) -> Column:
        price = low + step * ((p0 * 2 - low) / (points - 1))
        demand = _c(base_demand) * F.exp(F.lit(float(a)) + F.lit(float(b)) * F.ln(F.try_divide(price, p0)))
        return F.struct(((price - _c(unit_cost)) * demand).alias("profit"), (-step).alias("s"), price.alias("price"), demand.alias("demand"))

    def beside(price: Column) -> list[Column]:
        at = F.floor(F.try_divide((price - low) * (points - 1), p0 * 2 - low))
        return [F.greatest(F.lit(0), F.least(F.lit(points - 1), at + i)).cast("int") for i in (-1, 0, 1, 2)]

    turn = F.try_divide(_c(unit_cost) * float(b), F.lit(float(b) + 1))
    steps = [F.lit(0), F.lit(points - 1), *beside(turn), *beside(F.lit(0.0))]
    best = F.array_max(F.array(*[point(s) for s in steps]))
    return df.select(*keys, best.alias("_b")).select(
        *keys, F.col("_b.price").alias("price"), F.col("_b.demand").alias("quantity"), F.col("_b.profit").alias("profit"), F.lit(float(b)).alias("elasticity")
    )


# --- shelf space --------------------------------------------------------------------------


def _trio_profits(space: Sequence[Column], base: Sequence[str], margin: Sequence[str], effects: Sequence[Sequence[float]]) -> list[Column]:
    """Profit of each of three products under a space allocation with cross effects."""
    out = []
    for i in range(3):
        sales = F.col(base[i]).cast("double")
        for j in range(3):
            sales = sales * (1 + F.lit(float(effects[i][j])) * space[j])
        out.append(sales * F.col(margin[i]))
    return out


def shelf_space_curve(
    df: DataFrame,
    keys: Sequence[str],
    base: Sequence[str],
    margin: Sequence[str],
    space: Sequence[float],
    effects: Sequence[Sequence[float]],
    focus: int = 0,
    locked: int = 1,
    min_space: float = 5.0,
    total_space: float = 50.0,
    points: int = 50,
) -> DataFrame:
    """Profits of a product trio while the focus product's space runs over a grid.

    The locked product keeps its space, the third one gets the rest; grid points that leave it
    less than the minimum are dropped.
    """
    other = 3 - focus - locked
    width = (total_space - 2 * min_space) / (points - 1)
    grid = df.select(*keys, *base, *margin).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    own = F.lit(min_space) + F.col("step") * width
    alloc: list[Column] = [F.lit(0.0)] * 3
    alloc[focus], alloc[locked] = own, F.lit(float(space[locked]))
    alloc[other] = F.lit(total_space) - own - F.lit(float(space[locked]))
    profits = _trio_profits(alloc, base, margin, effects)
    return grid.where(alloc[other] >= min_space).select(
        *keys,
        "step",
        own.alias("space"),
        *[p.alias(f"p{i + 1}_profit") for i, p in enumerate(profits)],
        (profits[0] + profits[1] + profits[2]).alias("total_profit"),
    )


def shelf_space_optimum(
    df: DataFrame,
    keys: Sequence[str],
    base: Sequence[str],
    margin: Sequence[str],
    space: Sequence[float],
    effects: Sequence[Sequence[float]],
    focus: int = 0,
    locked: int = 1,
    min_space: float = 5.0,
    total_space: float = 50.0,
    points: int = 50,
) -> DataFrame:
    """Best allocation per trio, its gain over the given one, and the best profit per space."""
    other = 3 - focus - locked
    curve = shelf_space_curve(df, keys, base, margin, space, effects, focus, locked, min_space, total_space, points)
    # A trio has at most ``points`` rows; the smallest space wins ties.
    best = curve.groupBy(*keys).agg(
        F.max_by(F.struct("space", "total_profit", "p1_profit", "p2_profit", "p3_profit"), F.struct(F.col("total_profit"), -F.col("step"))).alias("_b")
    )
    now = _trio_profits([F.lit(float(s)) for s in space], base, margin, effects)
    current = df.select(*keys, (now[0] + now[1] + now[2]).alias("current_profit"))
    alloc: list[Column] = [F.lit(0.0)] * 3
    alloc[focus], alloc[locked] = F.col("_b.space"), F.lit(float(space[locked]))
    alloc[other] = F.lit(total_space) - F.col("_b.space") - F.lit(float(space[locked]))
    per_space = [F.coalesce(F.try_divide(F.col(f"_b.p{i + 1}_profit"), alloc[i]), F.lit(0.0)) for i in range(3)]
    strongest = F.array_max(F.array(*[F.struct(p.alias("v"), F.lit(-i).alias("i")) for i, p in enumerate(per_space)]))
    gain = F.col("_b.total_profit") - F.col("current_profit")
    return best.join(current, list(keys)).select(
        *keys,
        F.col("_b.space").alias("focus_space"),
        alloc[other].alias("other_space"),
        F.col("_b.total_profit").alias("optimal_profit"),
        "current_profit",
        gain.alias("profit_improvement"),
        F.when(F.col("current_profit") > 0, gain / F.col("current_profit") * 100).otherwise(0.0).alias("improvement_pct"),
        *[p.alias(f"p{i + 1}_profit_per_space") for i, p in enumerate(per_space)],
        F.concat(F.lit("p"), (1 - strongest["i"]).cast("string")).alias("most_efficient"),
    )


def cross_effects(df: DataFrame, source: str, target: str, effect: str, keys: Sequence[str] = ()) -> DataFrame:
    """Effects between different products ranked by strength, positive and negative apart."""
    kind = F.when(F.col(effect) > 0, "positive").otherwise("negative")
    pairs = df.where(F.col(source) != F.col(target)).withColumn("kind", kind)
    # Two kinds only: ranked inside slices of the strength, then moved by the size of those before.
    pairs = pairs.withColumn("_slice", value_slices(pairs, -F.abs(F.col(effect).cast("double")), parallelism(df))[0])
    groups = [*keys, "kind", "_slice"]
    before = Window.partitionBy(*keys, "kind").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pairs.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(groups)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    order = [F.desc(F.abs(F.col(effect))), F.col(source), F.col(target)]
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    same = F.lit(True)
    for i, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    return ranked.join(offsets, same).select(*df.columns, "kind", (F.col("_r") + F.col("_off")).cast("int").alias("strength_rank"))
