"""Inputs that once lost values, failed or went to one task."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions.exprs import parse_datetime_any
from sievework.functions.ordered import with_known_neighbours
from sievework.operators import convert, customer, forecast, inventory, models, outliers, schema, timeseries
from sievework.sources import files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text,want",
    [
        ("12/1/2010 8:26", dt.datetime(2010, 12, 1, 8, 26)),
        ("05-Jan-2024", dt.datetime(2024, 1, 5)),
        ("Jan 5, 2024", dt.datetime(2024, 1, 5)),
        ("May 5, 2024 7:05:09", dt.datetime(2024, 5, 5, 7, 5, 9)),
        ("september 30, 2023", dt.datetime(2023, 9, 30)),
        ("2024/01/05 10:00", dt.datetime(2024, 1, 5, 10)),
        ("01/05/85", dt.datetime(1985, 1, 5)),
        ("01/05/68", dt.datetime(2068, 1, 5)),
        ("05-Jan-69", dt.datetime(1969, 1, 5)),
        ("2024-02-29", dt.datetime(2024, 2, 29)),
        ("02/30/2024", None),
        ("1234", None),
        ("n/a", None),
        ("", None),
        (None, None),
    ],
)
def test_common_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "d string").select(parse_datetime_any("d")).first()[0] == want


def test_one_bad_date_leaves_the_others(spark):
    rows = [(f"{d:02d}.03.2024",) for d in range(1, 21)] + [("bad",), (None,)]
    got = [r[0] for r in convert.convert_datetime_columns(spark.createDataFrame(rows, "d string"), ["d"]).collect()]
    assert got[:20] == [dt.datetime(2024, 3, d) for d in range(1, 21)] and got[20:] == [None, None]
    assert convert.detect_date_pattern(spark.createDataFrame([(None,)], "d string"), "d") is None


def test_integers_keep_every_digit(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(str(big), big), ("2.0", 1), ("2.5", -1), ("1e3", 0), (None, None), ("9" * 30, 7)], "t string, n bigint")
    got = [tuple(r) for r in convert.convert_columns(df, {"t": "int", "n": "int"}).collect()]
    assert got == [(big, big), (2, 1), (None, -1), (1000, 0), (None, None), (None, 7)]
    ids = convert.coerce_by_name(spark.createDataFrame([(str(big), "1.5"), (None, "x")], "customer_id string, price string"))
    assert ids.dtypes == [("customer_id", "bigint"), ("price", "double")]
    assert [tuple(r) for r in ids.collect()] == [(big, 1.5), (None, None)]


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,n\n1,"say ""hi"", ok",5\n2,"two\nlines",6\n')
    got = [tuple(r) for r in files.load(spark, str(tmp_path / "a.csv"), "csv").collect()]
    assert got == [(1, 'say "hi", ok', 5), (2, "two\nlines", 6)]
    files.write_csv(spark.createDataFrame([(1, 'a "b", c')], "id int, t string"), f"{tmp_path}/out")
    parts = [pd.read_csv(f) for f in (tmp_path / "out").glob("part-*") if f.stat().st_size]
    assert pd.concat(parts).t.tolist() == ['a "b", c']


def test_rows_without_a_date_give_nothing(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(days=i), i, float(i) if i % 3 == 0 else None) for i in range(30)] + [(None, 99, 777.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, k int, v double")
    got = with_known_neighbours(df, [], "t", "k", "v").collect()
    assert len(got) == 30 and all(777.0 not in (r["_prev"], r["_next"]) for r in got)


def test_text_tie_breaker_on_a_hot_date(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(day, f"id-{i:04d}", float(i) if i % 50 == 0 else None) for i in range(400)] + [(day + dt.timedelta(days=i), "z", None) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, k string, v double")
    got = {(r["t"], r["k"]): r for r in with_known_neighbours(df, [], "t", "k", "v").collect()}
    assert all(got[day, f"id-{i:04d}"]["_prev"] == i // 50 * 50 and got[day, f"id-{i:04d}"]["_pos"] == i for i in range(400))


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, label string")
    assert outliers.iqr_report(df, ["x"]).collect() == []
    assert schema.role_table(df.select("label")).collect() == []
    assert outliers.IsolationForest(["x"]).fit(df.where("label = 'none'")) is not None


def test_multiplicative_decomposition_with_zero_trend(spark):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 0.0) for i in range(28)]
    out = timeseries.decompose(spark.createDataFrame(rows, "s string, ts timestamp_ntz, value double"), ["s"], 7, "multiplicative")
    assert out.count() == 28


def test_exponential_mean_equals_pandas(spark):
    rng = np.random.default_rng(3)
    values = [None if i in (0, 7, 8) else float(v) for i, v in enumerate(rng.normal(size=60))]
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), v) for s in ("a", "b") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, value double").repartition(5)
    got = timeseries.exponential_mean(df, ["s"], 0.3).orderBy("s", "ts").toPandas()
    want = pd.Series(values, dtype=float).ewm(alpha=0.3, adjust=True).mean()
    for s in ("a", "b"):
        assert np.allclose(got[got.s == s].fitted.to_numpy(dtype=float), want, equal_nan=True)


def test_hourly_grain_and_daily_cycle(spark):
    start = dt.datetime(2024, 3, 30, 5)
    rows = [("a", start + dt.timedelta(hours=i, minutes=i % 60), float(10.0 + np.sin(2 * np.pi * ((i + 5) % 24) / 24))) for i in range(240) if i % 50]
    hourly = timeseries.resample(spark.createDataFrame(rows, "s string, t timestamp_ntz, v double"), ["s"], "t", "v", "H", "mean")
    got = hourly.orderBy("ts").collect()
    assert [r.ts for r in got] == [start + dt.timedelta(hours=i) for i in range(1, 240)]
    assert timeseries.suggested_period(hourly, ["s"], "H").first()["period"] == 24
    ahead = forecast.forecast_fourier(hourly, ["s"], "H", 24, "daily").where("kind = 'forecast'").orderBy("ts").toPandas()
    want = [10.0 + np.sin(2 * np.pi * ((i + 5) % 24) / 24) for i in range(240, 264)]
    assert len(ahead) == 24 and np.abs(ahead.fitted.to_numpy() - want).max() < 0.1
    with pytest.raises(ValueError):
        forecast.forecast_fourier(hourly, ["s"], "D", 5, "daily")


def test_price_optimum_needs_no_shuffle(spark):
    items = spark.createDataFrame([(i, 100.0 + i, 5.0 + i, 2.0) for i in range(20)], "k int, d double, p double, c double")
    best = inventory.price_optimum(items, ["k"], F.col("d"), F.col("p"), F.col("c"))
    assert "Exchange" not in plan_of(best)
    grid = inventory.price_grid(items, ["k"], F.col("d"), F.col("p"), F.col("c"), -2.0, 0.5).toPandas()
    top = grid.sort_values(["k", "profit", "step"], ascending=[True, False, True]).groupby("k").first()
    got = best.toPandas().set_index("k")
    assert np.allclose(got.profit, top.profit) and np.allclose(got.price, top.price)


def test_cross_effects_are_ranked_over_all_slices(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{i % 23}", f"q{i}", float(round(x, 1))) for i, x in enumerate(rng.normal(size=500))] + [("same", "same", 9.0)]
    got = inventory.cross_effects(spark.createDataFrame(rows, "a string, b string, e double"), "a", "b", "e").toPandas()
    for _, part in got.groupby("kind"):
        part = part.sort_values("strength_rank")
        assert part.strength_rank.tolist() == list(range(1, len(part) + 1))
        assert part[["a", "b"]].values.tolist() == part.assign(s=-part.e.abs()).sort_values(["s", "a", "b"])[["a", "b"]].values.tolist()


def test_customers_with_date_texts(spark):
    rows = [("c1", "12/1/2010 8:26", 2.0, 3.0), ("c1", "12/5/2010 9:00", 1.0, 4.0), ("c2", "bad", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "c string, d string, q double, p double")
    got = {r.c: r for r in customer.customer_table(df, "c", "d", "q", "p").collect()}
    assert got["c1"].frequency == 2 and got["c1"].total_revenue == 10.0
    assert got["c1"].first_purchase == dt.datetime(2010, 12, 1, 8, 26)


def test_many_countries_and_classes(spark):
    rows = [(i, f"land {i % 320}", float(i)) for i in range(640)]
    df = spark.createDataFrame(rows, "k int, g string, x double")
    with pytest.raises(ValueError):
        models.train(df, "k", ["x"], "g", "decision_tree_classifier")
    trained = models.train(df.where("k % 320 < 60"), "k", ["x"], "g", "decision_tree_classifier", max_classes=None, maxDepth=2)
    assert len(trained.labels) == 60
