import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sievework.functions.exprs import date_shape, nan_to_null, parse_datetime_any
from sievework.operators import cleaning, convert, encode, missing, outliers, schema, transform
from sievework.sources import files


def col(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, math.nan), (2, None), (3, 4.0)], "id int, v double")
    assert col(nan_to_null(df), "v") == [None, None, 4.0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("12/1/2010 8:26 PM", dt.datetime(2010, 12, 1, 20, 26)),
        ("12/1/2010 12:05 am", dt.datetime(2010, 12, 1, 0, 5)),
        ("01/05/2024 10:00:00.5", dt.datetime(2024, 1, 5, 10, 0, 0, 500000)),
        ("05.01.2024", dt.datetime(2024, 5, 1)),
        ("2024.01.05", dt.datetime(2024, 1, 5)),
        ("20240105", dt.datetime(2024, 1, 5)),
        ("13/01/2024", dt.datetime(2024, 1, 13)),
        ("31-12-2024 23:59", dt.datetime(2024, 12, 31, 23, 59)),
        ("Thu, 05 Jan 2024", dt.datetime(2024, 1, 5)),
        ("Thursday, September 5, 2024", dt.datetime(2024, 9, 5)),
        ("05-01-2024", dt.datetime(2024, 5, 1)),
        ("13/13/2024", None),
        ("01/05/2024 25:00", None),
        ("01/05/2024 13:00 PM", None),
        ("12:30", None),
        ("2", None),
    ],
)
def test_common_date_texts(spark, text, want):
    assert spark.createDataFrame([(text,)], "d string").select(parse_datetime_any("d")).first()[0] == want


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Unit Price` int, `unit price` int, x int")
    assert schema.with_unique_names(schema.standardise_names(df)).columns == ["unit_price", "unit_price_1", "x"]
    assert schema.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]


def test_drop_nulls_and_duplicates(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert rows(schema.drop_duplicate_rows(df)) == [(1, None), (2, "x")]
    assert rows(schema.drop_null_rows(df)) == [(2, "x")]


def test_id_like(spark):
    data = [(i, f"A-{i}", i % 3, "same") for i in range(50)]
    df = spark.createDataFrame(data, "order_id int, ref string, grade int, word string")
    got = {r["column"]: (r["is_id"], r["reason"]) for r in schema.id_like_columns(df).collect()}
    assert got == {"order_id": (True, "name"), "ref": (True, "pattern"), "grade": (False, None), "word": (False, None)}


def test_semantic_types(spark):
    data = [(i, i % 2 == 0, f"text {i}", "ab"[i % 2], dt.datetime(2024, 1, 1)) for i in range(10)]
    df = spark.createDataFrame(data, "n int, b boolean, t string, c string, d timestamp_ntz")
    got = {r["column"]: r["semantic_type"] for r in schema.semantic_types(df).collect()}
    assert got == {"n": "numeric", "b": "boolean", "t": "text", "c": "categorical", "d": "datetime"}


def test_conversions(spark):
    df = spark.createDataFrame([(1, "3"), (2, "2.5"), (3, "x"), (4, None), (5, "NaN")], "id int, v string")
    assert col(convert.convert_columns(df, {"v": "numeric"}), "v") == [3.0, 2.5, None, None, None]
    assert col(convert.convert_columns(df, {"v": "int"}), "v") == [3, None, None, None, None]
    assert col(convert.strip_to_number(spark.createDataFrame([(1, "$ 1,234.50"), (2, "abc")], "id int, v string"), ["v"]), "v") == [1234.5, None]


def test_dates(spark):
    texts = ["2024-01-31", "1/5/2024", "2024/03/04", "13/45/2024", "12/31/99", None, "2024-02-30", "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, d string").withColumn("t", parse_datetime_any("d"))
    want = [dt.datetime(2024, 1, 31), dt.datetime(2024, 1, 5), dt.datetime(2024, 3, 4), None, dt.datetime(1999, 12, 31), None, None, None]
    assert col(df, "t") == want


@pytest.mark.parametrize("pattern,text", [("dd-MMM-yyyy", "03-Mar-2024"), ("dd.MM.yyyy", "31.12.2023"), ("MM/dd/yyyy HH:mm:ss", "12/31/2023 04:05:06"), ("yyyy/MM/dd", "2023/12/31")])
def test_detect_pattern(spark, pattern, text):
    import re

    assert re.match(date_shape(pattern), text)
    df = spark.createDataFrame([(text,), (None,)], "d string")
    assert convert.detect_date_pattern(df, "d") == pattern


def test_detect_pattern_reads_every_row(spark):
    df = spark.createDataFrame([("01/02/2024",)] * 50 + [("25/02/2024",)], "d string")
    assert convert.detect_date_pattern(df, "d") == "dd/MM/yyyy"
    assert convert.detect_date_pattern(spark.createDataFrame([("no",)], "d string"), "d") is None


def test_strict_datetime_fails(spark):
    df = spark.createDataFrame([("2024-01-01",), ("x",)], "d string")
    with pytest.raises(Exception, match="not a yyyy-MM-dd date"):
        convert.to_datetime_strict(df, "d", "yyyy-MM-dd").collect()


def test_auto_numeric_rule(spark):
    bad = spark.createDataFrame([("1", "1"), ("2", "n/a"), (None, "3")], "a string, b string")
    got, chosen = convert.auto_numeric(bad)
    assert chosen == ["a"] and dict(got.dtypes) == {"a": "double", "b": "string"}


def test_fills(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, None), (3, 4.0, "a"), (4, 10.0, "b"), (5, None, "a")], "id int, v double, c string")
    assert col(missing.fill_mean(df, ["v"]), "v") == [1.0, 5.0, 4.0, 10.0, 5.0]
    assert col(missing.fill_median(df, ["v"]), "v") == [1.0, 4.0, 4.0, 10.0, 4.0]
    assert col(missing.fill_mode(df, ["c"]), "c") == ["b", "a", "a", "b", "a"]
    assert col(missing.fill_zero(df, ["v"]), "v") == [1.0, 0.0, 4.0, 10.0, 0.0]
    report = {r["column"]: (r["n_missing"], r["pct_missing"]) for r in missing.missing_report(df).collect()}
    assert report == {"v": (2, 40.0), "c": (1, 20.0)}


def test_fill_of_an_all_null_column_keeps_it(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    for f in (missing.fill_mean, missing.fill_median):
        assert col(f(df, ["v"]), "v") == [None, None]
    assert col(missing.fill_mode(df, ["v"]), "v") == [None, None]


def test_iterative_fill_recovers_a_line(spark):
    data = [(i, float(i), 3.0 * i + 1 if i % 7 else None, 5.0 - i if i % 5 else None) for i in range(1, 200)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    got = missing.fill_iterative(df, ["a", "b", "c"]).orderBy("id").collect()
    assert len(got) == 199
    assert max(abs(r["b"] - (3 * r["id"] + 1)) for r in got) < 0.05
    assert max(abs(r["c"] - (5 - r["id"])) for r in got) < 0.05


def test_zscore_is_sequential_and_keeps_nulls(spark):
    data = [(i, float(i % 5), float(i % 7)) for i in range(100)] + [(100, 1000.0, 3.0), (101, None, 1.0), (102, 1.0, 900.0)]
    df = spark.createDataFrame(data, "id int, a double, b double")
    kept = col(outliers.remove_zscore_outliers(df, ["a", "b"]), "id")
    assert 100 not in kept and 102 not in kept and 101 in kept
    constant = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, a double")
    assert outliers.remove_zscore_outliers(constant, ["a"]).count() == 2


def test_isolation_forest_finds_far_points(spark):
    data = [(i, (i * 37 % 101) / 101, (i * 53 % 97) / 97) for i in range(950)] + [(950 + i, 8.0 + i / 10, -9.0 - i / 10) for i in range(50)]
    df = spark.createDataFrame(data, "id int, a double, b double")
    got = outliers.flag_isolated(df, ["a", "b"], 0.05)
    flagged = {r["id"] for r in got.where("is_outlier").collect()}
    assert len(flagged & set(range(950, 1000))) >= 45
    assert got.count() == 1000


def test_cleaning_sequence(spark):
    data = [(1, 1.0, "a", "5"), (1, 1.0, "a", "5"), (2, None, None, "6"), (3, 3.0, "b", "7"), (4, 2.0, "a", "8")]
    df = spark.createDataFrame(data, "id int, v double, c string, n string")
    spec = cleaning.CleaningSpec(fill_mean=True, fill_mode=True, drop_duplicates=True, convert_numeric=True)
    out, report = cleaning.clean(df, spec)
    assert out.count() == 4 and dict(out.dtypes)["n"] == "double"
    assert out.where("id = 2").first()["v"] == 1.75 and out.where("id = 2").first()["c"] == "a"
    assert [r["step"] for r in report.orderBy("position").collect()] == ["fill_mean", "fill_mode", "drop_duplicates", "convert_numeric", "overall"]
    again, _ = cleaning.clean(out, spec)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_scaling(spark):
    df = spark.createDataFrame([(i, float(v), 7.0) for i, v in enumerate([1, 2, 3, 4, 10])], "id int, v double, k double")
    s = transform.scale(df, ["v", "k"], "standard")
    m = s.agg(F.avg("v"), F.stddev_pop("v"), F.avg("k")).first()
    assert m[0] == pytest.approx(0) and m[1] == pytest.approx(1) and m[2] == 0
    assert col(transform.scale(df, ["v", "k"], "minmax"), "k") == [0.0] * 5
    assert col(transform.scale(df, ["v"], "robust"), "v") == [-1.0, -0.5, 0.0, 0.5, 3.5]
    scaler = transform.fit_scaler(df, ["v"], "standard")
    assert col(scaler.inverse(scaler.transform(df)), "v") == pytest.approx([1, 2, 3, 4, 10])


def test_scale_guard(spark):
    df = spark.createDataFrame([(i, None if i == 3 else 1.0, "x" if i == 2 else "5", "1") for i in range(30)], "row_key int, v double, t string, ok string")
    with pytest.raises(ValueError, match="missing values"):
        transform.scale_guarded(df, ["v"])
    with pytest.raises(ValueError, match="not numbers"):
        transform.scale_guarded(df, ["t"])
    with pytest.raises(ValueError, match="identifiers"):
        transform.scale_guarded(df, ["row_key"])
    assert transform.scale_guarded(df, ["row_key"], proceed_with_ids=True).count() == 30


def test_power_lambdas(spark):
    # exp of a symmetric grid: the log (lambda 0) makes it symmetric.
    df = spark.createDataFrame([(math.exp(i / 40),) for i in range(-100, 101)], "v double")
    assert abs(transform.boxcox_lambda(df, "v", 0.0)) < 0.02
    linear = spark.createDataFrame([(float(i),) for i in range(-100, 101)], "v double")
    assert abs(transform.yeo_johnson_lambda(linear, "v") - 1.0) < 0.02


def test_row_combinations(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 3.0), (3, None, None)], "id int, a double, b double")
    want = {"sum": [5, 3, 0], "mean": [2.5, 3, None], "max": [3, 3, None], "min": [2, 3, None], "product": [6, 3, 1]}
    for op, values in want.items():
        assert col(transform.combine_row(df, ["a", "b"], op, "r"), "r") == values


def test_polynomials(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    got = transform.polynomial_features(df, ["a", "b"], 3).first().asDict()
    assert got["a__a__b"] == 12.0 and got["b__b__b"] == 27.0 and "b__a" not in got


def test_bins(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)] + [(11, None)], "id int, v double")
    assert col(encode.equal_width_bins(df, "v", 5), "v_binned") == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None]
    assert col(encode.quantile_bins(df, "v", 2), "v_bin") == [0] * 6 + [1] * 5 + [None]
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, v double")
    assert col(encode.equal_width_bins(flat, "v", 5), "v_binned") == [2, 2]
    with pytest.raises(ValueError, match="not distinct"):
        encode.quantile_bins(flat, "v", 4)
    assert col(encode.custom_bins(df, "v", [1, 4, 8], "c"), "c") == [None, 0, 0, 0, 1, 1, 1, 1, 1, None, None, None]


def test_one_hot_limits(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(60)], "id int, c string")
    with pytest.raises(ValueError, match="more than 50"):
        encode.one_hot(df, "c")
    few = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "o'x")], "id int, c string")
    got = encode.one_hot(few, "c")
    assert got.columns == ["id", "c_b", "c_o'x"] and col(got, "c_b") == [0, 1, 0, 0]
    stage, names = encode.one_hot_stage(few, ["c"])
    assert col(stage.transform(few), names[1]) == [0.0, 0.0, 0.0, 1.0]


def test_group_small_is_stable_on_ties(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["b", "a", "c", "c", None])], "id int, c string")
    assert col(encode.group_small_categories(df, 2), "c") == ["Other", "a", "c", "c", "Other"]
    assert col(encode.group_small_categories(df, 3), "c") == ["b", "a", "c", "c", None]


def test_sources(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "id int, name string, price double")
    files.write_csv(df, f"{tmp_path}/c")
    assert rows(files.read_csv(spark, f"{tmp_path}/c")) == [(1, "a", 1.5), (2, None, None)]
    files.write_json(df, f"{tmp_path}/j")
    assert rows(files.read_json(spark, f"{tmp_path}/j", df.schema)) == [(1, "a", 1.5), (2, None, None)]
    (tmp_path / "a.json").write_text('[{"id": 1, "price": "x"}, {"id": 2, "price": "3"}]')
    assert rows(files.load(spark, f"{tmp_path}/a.json", "json")) == [(1, None), (2, 3.0)]
    files.write_compressed(df, f"{tmp_path}/p")
    assert rows(files.read_parquet(spark, f"{tmp_path}/p")) == [(1, "a", 1.5), (2, None, None)]
    (tmp_path / "l.csv").write_bytes("id;name\n1;café\n".encode("latin-1"))
    assert files.csv_dialect(spark, f"{tmp_path}/l.csv") == (";", "ISO-8859-1")
    assert rows(files.read_csv_any(spark, f"{tmp_path}/l.csv")) == [(1, "café")]
    (tmp_path / "t.csv").write_text("id\tv\n1\t2\n")
    assert rows(files.load(spark, f"{tmp_path}/t.csv", "csv")) == [(1, 2)]
