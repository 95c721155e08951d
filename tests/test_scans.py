"""Scans over sorted slices against plain loops, whatever the number of partitions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import scans
from sievework.operators import joins, timeseries


def series(spark, sizes, nulls=True, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in sizes.items():
        for i in range(n):
            v = None if nulls and rng.random() < 0.1 else float(rng.normal())
            rows.append((name, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), v))
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "k string, ts timestamp_ntz, value double"), rows


def plain(rows, rows_back, period, keep):
    out = {}
    for name in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == name]
        v = [r[2] for r in own]
        total = weight = 0.0
        for i, x in enumerate(v):
            total, weight = total * keep + (x or 0.0), weight * keep + (x is not None)
            last = v[max(0, i - rows_back + 1) : i + 1]
            mean = sum(last) / rows_back if len(last) == rows_back and None not in last else None
            half = period // 2
            span = v[i - half : i + half + 1] if i >= half else []
            whole = len(span) == 2 * half + 1 and None not in span
            centre = (sum(span) - (0 if period % 2 else (span[0] + span[-1]) / 2)) / period if whole else None
            out[name, own[i][1]] = (i, total / weight if weight else None, mean, centre)
    return out


@pytest.mark.parametrize(("parts", "period"), [(1, 7), (3, 4), (40, 7), (150, 12)])
def test_scan_equals_loop(spark, parts, period, monkeypatch):
    df, rows = series(spark, {"a": 400, "b": 1, None: 30, "c": 60})
    monkeypatch.setattr(scans, "parallelism", lambda df: parts)

    def fn(run):
        return {
            "i": run.position + np.arange(len(run.values)),
            "ema": scans.exponential_means(run, 0.7),
            "mean": scans.moving_mean(run, 9),
            "centre": scans.centred_mean(run, period),
        }

    half = max(8, period // 2)
    got = scans.scan_series(df, ["k"], "ts", "value", {"i": "long", "ema": "double", "mean": "double", "centre": "double"}, fn, before=half, after=period // 2, keep=0.7)
    want = plain(rows, 9, period, 0.7)
    found = got.collect()
    assert len(found) == len(rows) and got.columns == ["k", "ts", "value", "i", "ema", "mean", "centre"]
    for r in found:
        for mine, other in zip((r.i, r.ema, r.mean, r.centre), want[r.k, r.ts]):
            assert (mine is None) == (other is None) and (mine is None or mine == pytest.approx(other, abs=1e-9)), (r, want[r.k, r.ts])


def test_long_way_equals_window(spark, monkeypatch):
    df, _ = series(spark, {"a": 90, "b": 40}, nulls=False)

    def everything():
        return [
            sorted(map(tuple, timeseries.decompose(df, ["k"], 6, extrapolate=True).select("k", "ts", F.round("trend", 9), F.round("seasonal", 9)).collect())),
            sorted(map(tuple, timeseries.forecast_linear(df, ["k"], "H", 3).select("k", "ts", F.round("fitted", 9)).collect())),
            sorted(map(tuple, timeseries.forecast_sma(df, ["k"], "H", 3).select("k", "ts", F.round("fitted", 9)).collect()), key=repr),
            sorted(map(tuple, joins.lag_difference(df, ["k"]).select("k", "ts", F.round("diff", 9)).collect()), key=repr),
        ]

    short = everything()
    monkeypatch.setattr(timeseries, "WINDOW_ROWS", 10)
    assert everything() == short


def test_empty_and_unknown(spark):
    df, _ = series(spark, {"a": 3})
    assert timeseries.exponential_mean(df.where(F.lit(False)), ["k"], 0.3).collect() == []
    nothing = df.withColumn("value", F.lit(None).cast("double"))
    assert [r.fitted for r in timeseries.exponential_mean(nothing, ["k"], 0.3).collect()] == [None] * 3


def test_forty_thousand_points_take_linear_time(spark):
    rows = spark.range(40_000).select(F.timestamp_seconds("id").alias("ts"), (F.col("id") % 97).cast("double").alias("value"))
    out = timeseries.exponential_mean(rows, [], 0.3)
    assert out.count() == 40_000 and out.where("fitted IS NULL").count() == 0
