import datetime as dt
import math

import pytest

from sievework.functions import probability as pr
from sievework.operators import profile, stats


def one(df):
    return df.first().asDict()


def by(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize(
    "got,want",
    [
        (pr.t_two_sided(2.228, 10), 0.05),
        (pr.t_two_sided(0.0, 5), 1.0),
        (pr.t_two_sided(1.96, 1e7), 0.05),
        (pr.f_tail(4.96, 1, 10), 0.05),
        (pr.f_tail(3.10, 3, 20), 0.05),
        (pr.chi2_tail(3.841, 1), 0.05),
        (pr.chi2_tail(18.307, 10), 0.05),
        (pr.chi2_tail(0.0, 3), 1.0),
    ],
)
def test_tail_probabilities(got, want):
    assert got == pytest.approx(want, abs=2e-4)


def test_summary_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, None, None)], "n int, c string, e double")
    got = by(profile.dataset_summary(df))
    assert got["n"]["n_distinct"] == 2 and got["c"]["n_missing"] == 1 and got["e"]["n_distinct"] == 0
    assert got["e"]["pct_missing"] == 100.0
    near = by(profile.dataset_summary(df, approximate=True))
    assert near["n"]["n_distinct"] == 2


def test_describe_edge_cases(spark):
    df = spark.createDataFrame([(1.0, None, 5.0)], "a double, b double, c double")
    got = by(profile.describe(df))
    assert got["a"]["q50"] == 1.0 and got["a"]["std"] is None
    assert got["b"]["count"] == 0 and got["b"]["q25"] is None
    empty = spark.createDataFrame([], "a double")
    assert by(profile.describe(empty))["a"]["count"] == 0


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 10, 10]], "v double")
    got = [r["n_rows"] for r in profile.histogram(df, "v", 5).orderBy("bin").collect()]
    assert got == [2, 1, 0, 0, 2]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r["n_rows"] for r in profile.histogram(flat, "v", 2).orderBy("bin").collect()] == [0, 2]


def test_categorical_stats_counts_null(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "c string")
    got = by(profile.categorical_stats(df))["c"]
    assert got == {"column": "c", "n_distinct": 3, "top_value": None, "top_count": 2, "top_pct": 50.0}


def test_rollups_refuse_wide_columns(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(60)], "c string")
    with pytest.raises(ValueError):
        profile.category_distribution(df, "c")
    with pytest.raises(ValueError):
        profile.pie_shares(df, "c")


def test_correlation_drops_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): 1.0, ("b", "a"): 1.0, ("b", "b"): 1.0}
    assert profile.strong_pairs(df).count() == 1


def test_skewness_is_bias_corrected(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double")
    got = one(profile.skewness_table(df))
    n, xs = 5, [1, 2, 3, 4, 100]
    m = sum(xs) / n
    g1 = (sum((x - m) ** 3 for x in xs) / n) / (sum((x - m) ** 2 for x in xs) / n) ** 1.5
    assert got["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert got["interpretation"] == "Highly right-skewed"


def test_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5, 23),), (dt.datetime(2024, 1, 7, 1),), (None,)], "d timestamp_ntz")
    got = one(profile.date_analysis(df))
    assert (got["range_days"], got["weekend_rows"], got["weekday_rows"], got["n_missing"]) == (1, 1, 1, 1)


def test_contingency_fills_zero_cells(spark, rows):
    df = spark.createDataFrame([("x", "p"), ("y", "q"), ("x", "p"), (None, "q")], "a string, b string")
    assert rows(profile.contingency_grid(df, "a", "b")) == [("x", "p", 2), ("x", "q", 0), ("y", "p", 0), ("y", "q", 1)]
    assert rows(profile.contingency(df, "a", "b")) == [("x", "p", 2, 2, 2), ("y", "q", 1, 1, 1)]


def test_tests_on_degenerate_input(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", "x"), (1.0, 2.0, "a", "x"), (1.0, None, "a", None), (1.0, 2.0, None, "y")], "v double, w double, g string, h string")
    assert one(stats.one_sample_t(df, "v"))["statistic"] is None
    assert one(stats.welch_t(df, "v", "w"))["statistic"] is None
    assert one(stats.anova(df, "v", "g"))["statistic"] is None
    got = one(stats.chi2_independence(df, "g", "h"))
    assert (got["statistic"], got["dof"], got["p_value"]) == (None, 0.0, None)
    none = df.where("v > 5")
    assert one(stats.one_sample_t(none, "v"))["statistic"] is None
    assert one(stats.welch_t(none, "v", "w"))["p_value"] is None
    assert one(stats.anova(none, "v", "g"))["p_value"] is None
    assert one(stats.chi2_independence(none, "g", "h"))["p_value"] is None
    assert one(stats.chi2_uniform(none, "g"))["p_value"] is None


def test_t_tests(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0), (4.0, 1.0), (5.0, None)], "a double, b double")
    got = one(stats.one_sample_t(df, "a"))
    assert got["statistic"] == pytest.approx(4.242640687) and got["p_value"] == pytest.approx(0.013235599, abs=1e-8)
    got = one(stats.welch_t(df, "a", "b"))
    assert got["statistic"] == pytest.approx(-1 / (2.5 / 5 + 38 / 3 / 4) ** 0.5)


def test_yates_on_a_2x2_table(spark):
    data = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 40
    got = one(stats.chi2_independence(spark.createDataFrame(data, "a string, b string"), "a", "b"))
    # Expected 12, 18, 28, 42; every deviation is 2, corrected to 1.5.
    assert got["statistic"] == pytest.approx(2.25 * (1 / 12 + 1 / 18 + 1 / 28 + 1 / 42))
    assert got["dof"] == 1.0


def test_anova(spark):
    data = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0), ("c", None)]
    got = one(stats.anova(spark.createDataFrame(data, "g string, v double"), "v", "g"))
    assert got["statistic"] == pytest.approx(13.5) and got["p_value"] == pytest.approx(0.0213, abs=1e-4)


def test_pearson_perfect(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "a double, b double")
    got = one(stats.pearson(df, "a", "b"))
    assert got["p_value"] == pytest.approx(0.0, abs=1e-9) and got["strength"] == "strong" and got["direction"] == "positive"
