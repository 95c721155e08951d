import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import order_stats as os_
from sievework.functions.ordered import with_known_neighbours, with_slices
from sievework.operators import encode, missing, outliers


@pytest.fixture
def scale_path(monkeypatch):
    """Make every size check fail, so that the path for large data runs."""
    monkeypatch.setattr(os_, "DISTINCT_LIMIT", 0)
    monkeypatch.setattr(os_, "BRACKET_LIMIT", 20)
    monkeypatch.setattr(os_, "SKETCH_ACCURACY", 50)


def numbers(spark, n=5000, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.lognormal(3, 2, n), 2)
    v[: n // 3] = 7.25  # a third of the rows share one value
    g = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 5, n).astype(str))
    data = [(int(i), str(a), None if i % 50 == 0 else float(b)) for i, (a, b) in enumerate(zip(g, v))]
    return spark.createDataFrame(data, "id bigint, g string, v double"), data


def test_exact_quantiles_large_path(spark, scale_path):
    df, data = numbers(spark)
    known = [v for _, _, v in data if v is not None]
    probs = [0.0, 0.05, 0.2, 0.5, 0.75, 0.99, 1.0]
    got = os_.exact_quantiles(df, ["v"], probs)["v"]
    assert got == pytest.approx(list(np.quantile(known, probs)), rel=1e-12)


def test_value_at_ranks_large_path(spark, scale_path):
    df, data = numbers(spark, seed=3)
    known = sorted(v for _, _, v in data if v is not None)
    ranks = [0, 10, 2500, len(known) - 1]
    assert os_.value_at_ranks(df, "v", ranks) == {r: known[r] for r in ranks}


def test_value_at_ranks_small_path(spark):
    df, data = numbers(spark, 997)
    known = sorted(v for _, _, v in data if v is not None)
    ranks = [0, 1, 48, 500, len(known) - 1]
    assert os_.value_at_ranks(df, "v", ranks) == {r: known[r] for r in ranks}


@pytest.mark.parametrize("large", [False, True])
def test_grouped_quantiles(spark, monkeypatch, large):
    df, data = numbers(spark, seed=5)
    df = df.withColumn("g", F.when(F.col("g") != "3", F.col("g")))  # a NULL group
    if large:
        monkeypatch.setattr(os_, "DISTINCT_LIMIT", 0)
    got = {r["g"]: (r["a"], r["b"]) for r in os_.grouped_quantiles(df, ["g"], "v", [0.3, 0.5], ["a", "b"]).collect()}
    groups = {}
    for _, g, v in data:
        if v is not None:
            groups.setdefault(None if g == "3" else g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(vs, [0.3, 0.5])), rel=1e-12)


def test_quantiles_of_empty_and_null(spark):
    empty = spark.createDataFrame([], "v double")
    assert os_.exact_quantiles(empty, ["v"], [0.5])["v"] == [None]
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    assert os_.exact_quantiles(nulls, ["v"], [0.5])["v"] == [None]


def test_slices_follow_the_order_and_split_a_hot_date(spark):
    data = [(1, 5 if i < 600 else i, i) for i in range(1000)]
    df = spark.createDataFrame(data, "k int, t bigint, id bigint")
    got = with_slices(df, "t", "id").orderBy("t", "id").select("_slice").collect()
    s = [r[0] for r in got]
    assert s == sorted(s)
    assert max(s.count(x) for x in set(s)) < 400


def brute_fill(values):
    fwd, last = [], None
    for v in values:
        last = v if v is not None else last
        fwd.append(last)
    nxt = None
    for i in range(len(values) - 1, -1, -1):
        nxt = values[i] if values[i] is not None else nxt
        if fwd[i] is None:
            fwd[i] = nxt
    return fwd


def gappy(spark):
    rng = np.random.default_rng(2)
    data = []
    for k, n in (("a", 700), ("b", 60), (None, 25)):
        vals = [None if rng.random() < 0.7 else float(rng.integers(0, 100)) for _ in range(n)]
        vals[n // 2] = 1.0
        # Many rows share a date; the id decides.
        data += [(k, 1000 if i < n // 2 else 1000 + i, i, v) for i, v in enumerate(vals)]
    return spark.createDataFrame(data, "k string, t bigint, id bigint, v double"), data


def test_forward_backward_fill_across_slices(spark):
    df, data = gappy(spark)
    got = missing.fill_forward_backward(df, ["k"], "t", "id", "v").collect()
    for k in ("a", "b", None):
        mine = [r["v"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["id"])]
        assert mine == brute_fill([v for kk, _, _, v in data if kk == k])


def test_fill_without_keys(spark):
    df, data = gappy(spark)
    one = df.where("k = 'a'").drop("k")
    got = [r["v"] for r in missing.fill_forward_backward(one, [], "t", "id", "v").orderBy("id").collect()]
    assert got == brute_fill([v for k, _, _, v in data if k == "a"])


def test_fill_fails_on_a_series_without_values(spark):
    df = spark.createDataFrame([("a", 1, 1, 1.0), ("b", 1, 1, None)], "k string, t int, id int, v double")
    with pytest.raises(Exception, match="no known value"):
        missing.fill_forward_backward(df, ["k"], "t", "id", "v").collect()


def test_linear_interpolation(spark):
    vals = [None, 2.0, None, None, 8.0, None]
    df = spark.createDataFrame([(i, i, v) for i, v in enumerate(vals)], "t int, id int, v double")
    got = [r["v"] for r in missing.fill_linear(df, [], "t", "id", "v").orderBy("id").collect()]
    assert got == [None, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_positions_count_over_slices(spark):
    df, _ = gappy(spark)
    got = with_known_neighbours(df.where("k = 'a'"), ["k"], "t", "id", "v").orderBy("id").collect()
    assert [r["_pos"] for r in got] == list(range(700))


def test_winsorise_uses_ranks(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100] * 4], "v double")
    got = sorted(r[0] for r in outliers.winsorise(df, ["v"], 0.05).collect())
    # n = 40, k = 2: clamped to the third smallest and largest value.
    assert got[0] == 1.0 and got[-1] == 100.0
    got = sorted(r[0] for r in outliers.winsorise(df, ["v"], 0.1).collect())
    assert got[0] == 2.0 - 1.0 if got[0] == 1.0 else got[0] == 2.0
    assert got[-1] == 9.0


@pytest.mark.parametrize("large", [False, True])
def test_label_dictionary(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(encode, "BROADCAST_LEVELS", 10)
    words = [f"w{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "w string")
    got = {r["w"]: r["code"] for r in encode.label_dictionary(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(words)}
    coded = encode.label_encode(df, "w", "c")
    assert coded.where("w IS NULL AND c IS NOT NULL").count() == 0
    back = encode.label_decode(coded, encode.label_dictionary(df, "w"), "w", "c")
    assert back.where("NOT (w <=> w_decoded)").count() == 0


@pytest.mark.parametrize("fine", [False, True])
def test_slices_grow_with_the_value_and_isolate_a_hot_one(spark, monkeypatch, fine):
    if fine:
        monkeypatch.setattr(os_, "MAX_CUTS", 8)
    df, _ = numbers(spark)
    known = df.where("v IS NOT NULL")
    place, hot = os_.value_slices(known, F.col("v"), 32)
    assert 7.25 in hot
    got = known.select("v", place.alias("s")).orderBy("v").collect()
    s = [r["s"] for r in got]
    assert s == sorted(s) and len(set(s)) > 16
    alone = {r["s"] for r in got if r["v"] == 7.25}
    assert len(alone) == 1 and all(r["v"] == 7.25 for r in got if r["s"] in alone)


@pytest.mark.parametrize("slices", [8, 40])
def test_fill_with_divided_slices(spark, monkeypatch, slices):
    monkeypatch.setattr(os_, "MAX_CUTS", 8)
    monkeypatch.setattr("sievework.functions.ordered.parallelism", lambda df: slices)
    df, data = gappy(spark)
    got = missing.fill_forward_backward(df, ["k"], "t", "id", "v").collect()
    mine = [r["v"] for r in sorted((r for r in got if r["k"] == "a"), key=lambda r: r["id"])]
    assert mine == brute_fill([v for k, _, _, v in data if k == "a"])
