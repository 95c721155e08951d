import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievework.operators import customer as cu
from sievework.operators import forecast, inventory as inv, timeseries as ts


def monthly(spark, n=48, noise=0.0):
    """Upward trend of 2 per month, +30 in months 3-5, +20 in months 9-11."""
    data = []
    for i in range(n):
        y, m = 2020 + i // 12, i % 12 + 1
        last = (dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1))
        v = 100 + 2.0 * i + (30 if 3 <= m <= 5 else 20 if 9 <= m <= 11 else 0) + noise * ((i * 7919) % 13 - 6)
        data.append(("s", last, v))
    return spark.createDataFrame(data, "k string, ts date, value double")


def test_resample_keeps_empty_buckets(spark):
    data = [("a", dt.datetime(2024, 1, 1), 1.0), ("a", dt.datetime(2024, 1, 4), 2.0), ("b", dt.datetime(2024, 2, 1), 5.0)]
    df = spark.createDataFrame(data, "k string, d timestamp_ntz, v double")
    got = [(r["k"], r["value"]) for r in ts.resample(df, ["k"], "d", "v", "D", "mean").orderBy("k", "ts").collect()]
    assert got == [("a", 1.0), ("a", None), ("a", None), ("a", 2.0), ("b", 5.0)]
    got = [r["value"] for r in ts.resample(df, ["k"], "d", "v", "D", "sum").orderBy("k", "ts").collect()]
    assert got == [1.0, 0.0, 0.0, 2.0, 5.0]


def test_bucket_labels(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 14, 9), 1.0)], "d timestamp_ntz, v double")
    want = {"D": "2024-02-14", "W": "2024-02-18", "M": "2024-02-29", "Q": "2024-03-31", "Y": "2024-12-31"}
    for freq, label in want.items():
        assert str(ts.resample(df, [], "d", "v", freq, "sum").first()["ts"]) == label
    end = ts.resample(df, [], "d", "v", "M", "sum")
    assert [str(r["ts"]) for r in ts.future_dates(end, [], "M", 2).orderBy("step").collect()] == ["2024-03-31", "2024-04-30"]


@pytest.mark.parametrize("period", [4, 5, 12])
@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_decomposition_adds_back(spark, period, model):
    out = ts.decompose(monthly(spark, 48, 1.0), ["k"], period, model).orderBy("ts").collect()
    half = period // 2
    assert all(r["trend"] is None for r in out[:half] + out[-half:])
    for r in out[half:-half]:
        back = r["trend"] + r["seasonal"] + r["residual"] if model == "additive" else r["trend"] * r["seasonal"] * r["residual"]
        assert back == pytest.approx(r["value"])
    seasons = [r["seasonal"] for r in out[:period]]
    assert sum(seasons) / period == pytest.approx(0.0 if model == "additive" else 1.0)


def test_decomposition_extrapolates_a_line(spark):
    line = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0 + 2 * i) for i in range(30)], "ts date, value double")
    out = ts.decompose(line, [], 7, extrapolate=True).orderBy("ts").collect()
    assert [r["trend"] for r in out] == pytest.approx([5.0 + 2 * i for i in range(30)])


def test_simple_forecasts(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, i + 1), float(v)) for i, v in enumerate([1, 2, 3, 6])], "k string, ts date, value double")
    sma = ts.forecast_sma(df, ["k"], "D", 2, 3).orderBy("ts").collect()
    assert [r["fitted"] for r in sma] == pytest.approx([None, None, 2.0, 11 / 3, 11 / 3, 11 / 3])
    ema = ts.forecast_ema(df, ["k"], "D", 1, 0.5).orderBy("ts").collect()
    assert [r["fitted"] for r in ema] == pytest.approx([1.0, 5 / 3, 17 / 7, 65 / 15, 65 / 15])
    line = ts.forecast_linear(df, ["k"], "D", 1).orderBy("ts").collect()
    assert line[-1]["fitted"] == pytest.approx(7.0) and line[-1]["kind"] == "forecast"


@pytest.mark.parametrize("fit,limit", [(forecast.forecast_holt_winters, 25.0), (forecast.forecast_fourier, 14.0), (forecast.forecast_autoregressive, 6.0)])
def test_model_forecasts_stay_close(spark, fit, limit):
    full = monthly(spark, 60)
    past = full.where("ts < '2024-01-01'")
    ahead = fit(past, ["k"], "M", 12).where("kind = 'forecast'").select("ts", "fitted", "lower", "upper")
    joined = ahead.join(full, "ts").collect()
    assert len(joined) == 12
    assert max(abs(r["fitted"] - r["value"]) for r in joined) < limit
    assert all(r["lower"] <= r["fitted"] <= r["upper"] for r in joined)


def test_short_series_do_not_fail(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 31), 5.0), ("b", dt.date(2024, 1, 31), None)], "k string, ts date, value double")
    for fit in (forecast.forecast_holt_winters, forecast.forecast_fourier, forecast.forecast_autoregressive):
        assert fit(df, ["k"], "M", 3).count() == 8


def test_accuracy(spark):
    df = spark.createDataFrame([("a", 10.0, 8.0), ("a", 4.0, 0.0), ("b", None, 3.0)], "p string, y double, f double")
    got = ts.accuracy_rows(df, "y", "f").orderBy("y").collect()
    assert len(got) == 2 and got[0]["pct_error"] is None and got[1]["pct_error"] == 25.0
    assert ts.accuracy_by(df, ["p"], "y", "f").collect()[0]["mape"] == 25.0
    assert ts.accuracy_overall(df, "y", "f").first()["mae"] == 3.0


def test_frequency(spark):
    df = monthly(spark, 24)
    assert ts.infer_frequency(df, ["k"], "ts").first()["freq"] == "M"
    assert ts.suggested_period(df, ["k"], "M").first()["period"] == 6
    assert ts.suggested_period(df.limit(3), ["k"], "M").first()["period"] is None


def test_rfm_and_clv(spark):
    day = dt.datetime
    data = [(1, day(2024, 1, 1), 10.0), (1, day(2024, 1, 11), 30.0), (2, day(2024, 1, 6), 5.0), (None, day(2024, 1, 2), 9.0)]
    df = spark.createDataFrame(data, "c int, d timestamp_ntz, a double")
    got = {r["c"]: r.asDict() for r in cu.simple_clv(cu.rfm(df, "c", "d", "a")).collect()}
    assert got[1]["recency"] == 1 and got[1]["clv"] == pytest.approx(40 * 365)
    assert got[2]["recency"] == 5 and got[2]["clv"] == pytest.approx(5 * 73)


def test_segments(spark):
    df = spark.createDataFrame([(s,) for s in (3, 4, 6, 7, 9, 10, 12, 13, 15)], "rfm_score int")
    got = [r["segment"] for r in cu.add_segment(df).orderBy("rfm_score").collect()]
    assert got == ["Lost", "At Risk", "At Risk", "Potential Loyalists", "Potential Loyalists", "Loyal Customers", "Loyal Customers", "Champions", "Champions"]


def test_customer_table_reads_text(spark):
    data = [("1", "2024-01-01", "2", "5.0"), ("1", "01/03/2024", "1", "x"), ("2", "2024-01-05", "-1", "3"), (None, "2024-01-05", "1", "3")]
    df = spark.createDataFrame(data, "c string, d string, q string, p string")
    got = cu.customer_table(df, "c", "d", "q", "p").collect()
    assert len(got) == 1 and got[0]["total_revenue"] == 10.0 and got[0]["frequency"] == 1


def test_inventory_formulas(spark):
    df = spark.createDataFrame([(1, 400.0), (2, 0.0)], "sku int, demand double")
    q = inv.economic_order_quantity(df, "demand", 500, 200, 0.2).orderBy("sku").collect()
    assert q[0]["eoq"] == pytest.approx(100.0) and q[1]["eoq"] == 0.0
    costs = inv.order_size_costs(df.withColumn("size", F.lit(0.0)), "size", "demand", 500, 200, 0.2).first()
    assert costs["total_cost"] == 0.0
    curve = inv.cost_curve(df.where("sku = 1"), ["sku"], "demand", 500, 200, 0.2).orderBy("step").collect()
    assert len(curve) == 20 and curve[5]["total_cost"] == pytest.approx(4000.0) and min(r["total_cost"] for r in curve) == curve[5]["total_cost"]
    saw = inv.inventory_sawtooth(df.where("sku = 1"), ["sku"], 100, "demand").orderBy("step").collect()
    assert len(saw) == 25 and saw[0]["inventory"] == 100.0 and saw[6]["inventory"] == pytest.approx(100.0)


def test_normal_quantile(spark):
    df = spark.createDataFrame([(0.01,), (0.5,), (0.95,), (0.999,), (0.0,), (1.0,)], "p double")
    got = [r[0] for r in df.select(inv.normal_quantile(F.col("p"))).collect()]
    assert got[:4] == pytest.approx([-2.3263478740, 0.0, 1.6448536270, 3.0902323062], abs=1e-7)
    assert got[4:] == [None, None]


def test_stockout_replay(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [10, 10, 10, 30]] + [("b", 5.0)], "sku string, d double")
    got = {r["sku"]: r.asDict() for r in inv.stockout_replay(df, ["sku"], "d", 1.0, 0.9, 2.0, 0.1).collect()}
    level = 15 + inv.z_value(0.9) * 10
    assert got["a"]["stock_outs"] == 1 and got["a"]["lost_profit"] == pytest.approx((30 - level) * 2)
    assert got["a"]["avg_excess"] == pytest.approx(3 * (level - 10) / 4) and got["a"]["action"] == "Raise Service"
    assert got["b"]["stock_outs"] == 0 and got["b"]["action"] == "Lower Service"


def test_price_optimum_is_the_grid_maximum(spark):
    df = spark.createDataFrame([(1, 1000.0, 10.0, 5.0)], "sku int, d double, p double, c double")
    best = inv.price_optimum(df, ["sku"], "d", "p", "c", -2.0, -1.5).first()
    grid = inv.price_grid(df, ["sku"], "d", "p", "c", -2.0, -1.5).collect()
    assert best["profit"] == pytest.approx(max(r["profit"] for r in grid))


@pytest.mark.parametrize("b", [-3.0, -1.5, -1.0, -0.4, 0.0, 0.5])
def test_price_optimum_of_every_elasticity(spark, b):
    data = [(i, d, p, c) for i, (d, p, c) in enumerate([(100.0, 10.0, 5.0), (7.0, 3.0, 2.9), (9.0, 20.0, 0.0), (5.0, 4.0, 11.0), (0.0, 8.0, 2.0), (3.0, -6.0, 1.0)])]
    df = spark.createDataFrame(data, "sku int, d double, p double, c double")
    best = {r.sku: r.profit for r in inv.price_optimum(df, ["sku"], "d", "p", "c", -2.0, b).collect()}
    grid = inv.price_grid(df, ["sku"], "d", "p", "c", -2.0, b).groupBy("sku").agg({"profit": "max"}).collect()
    assert best == pytest.approx({r[0]: r[1] for r in grid}, nan_ok=True)


def test_shelf_space_default_case(spark):
    df = spark.createDataFrame([(1, 4000.0, 2500.0, 2000.0, 2.0, 3.0, 6.0)], "t int, d0 double, d1 double, d2 double, m0 double, m1 double, m2 double")
    effects = ((0.2, 0.2, 0.1), (0.2, 0.3, -0.2), (0.1, -0.2, 0.4))
    args = (df, ["t"], ["d0", "d1", "d2"], ["m0", "m1", "m2"], (10, 10, 30), effects)
    best, curve = inv.shelf_space_optimum(*args).first(), inv.shelf_space_curve(*args).collect()
    assert best["optimal_profit"] == pytest.approx(max(r["total_profit"] for r in curve))
    assert best["current_profit"] == pytest.approx(4000 * 2 * 3 * 3 * 4 + 2500 * 3 * 3 * 4 * -5 + 2000 * 6 * 2 * -1 * 13)
