"""Queries for sources, schema work, conversion, missing values and outliers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievework.functions.exprs import nan_to_null
from sievework.operators import cleaning, convert, missing, outliers, profile, schema
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
from sievework.session import ensure_checkpoint_dir, union_rows
from sievework.sources import files


def _folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder for written copies."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/copy-{uuid.uuid4().hex}"


def _strptime(pattern: str) -> str:
    """The same pattern in the letters of the SQL engine."""
    letters = {"yyyy": "%Y", "yy": "%y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}
    return "".join(letters.get(p, p) for p in re.findall(r"y+|M+|d+|H+|m+|s+|.", pattern))


# --- sources and sinks -------------------------------------------------------------------

CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s01_csv_scan", CUSTOMER_SQL.replace("c_custkey,", "CAST(c_custkey AS INTEGER) AS c_custkey,"))
def csv_scan(spark, sf_dir):
    path = _folder(spark)
    files.write_csv(table(spark, sf_dir, "customer"), path)
    return files.read_csv(spark, path)


@query("s02_csv_dialect_scan", CUSTOMER_SQL)
def csv_dialect_scan(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "customer").write.option("header", True).option("sep", "|").option(
        "encoding", "ISO-8859-1"
    ).csv(path)
    return files.read_csv_any(spark, path, CUSTOMER_SCHEMA)


@query("s03_json_scan", CUSTOMER_SQL)
def json_scan(spark, sf_dir):
    path = _folder(spark)
    files.write_json(table(spark, sf_dir, "customer"), path)
    return files.read_json(spark, path, CUSTOMER_SCHEMA)


@query("s04_parquet_scan", "SELECT * FROM orders")
def parquet_scan(spark, sf_dir):
    return files.read_parquet(spark, f"{sf_dir}/orders.parquet")


@query("s05_csv_sink", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def csv_sink(spark, sf_dir):
    path = _folder(spark)
    files.write_csv(table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), path)
    return files.read_csv(spark, path, "o_orderstatus string, o_orderpriority string, n bigint")


@query(
    "s06_json_sink",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders",
)
def json_sink(spark, sf_dir):
    path = _folder(spark)
    files.write_json(dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), path)
    return files.read_json(spark, path, "o_orderkey bigint, o_orderpriority string")


@query("s07_compressed_copy", "SELECT * FROM part")
def compressed_copy(spark, sf_dir):
    path = _folder(spark)
    files.write_compressed(table(spark, sf_dir, "part"), path)
    return files.read_parquet(spark, path)


@query(
    "s08_batched_union",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer "
    "UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier",
)
def batched_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return files.union_batches([c, s])


# --- projection, filter, schema ----------------------------------------------------------


@query("p01_projection", "SELECT o_orderdate, o_totalprice FROM orders")
def projection(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")


@query("p02_numeric_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def numeric_projection(spark, sf_dir):
    return schema.select_kind(table(spark, sf_dir, "lineitem"), "numeric")


@query("p03_preview", f"SELECT * FROM {DIRTY_ORDERS} ORDER BY o_orderkey LIMIT 10")
def preview(spark, sf_dir):
    return schema.preview(dirty_orders(spark, sf_dir), 10, ["o_orderkey"])


@query("p04_standard_names", 'SELECT p_partkey AS part_key, p_retailprice AS retail_price FROM part')
def standard_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Part Key"), F.col("p_retailprice").alias("Retail Price"))
    return schema.standardise_names(p)


@query("p05_unique_names", "SELECT p_partkey AS v, p_size AS v_1, p_retailprice AS v_2 FROM part")
def distinct_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), F.col("p_size").alias("v"), F.col("p_retailprice").alias("v"))
    return schema.with_unique_names(p)


@query("p06_drop_null_rows", f"SELECT o_orderkey, o_orderpriority FROM {DIRTY_ORDERS} WHERE o_orderpriority IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    return schema.drop_null_rows(dirty_orders(spark, sf_dir), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


def _with_copies(spark, sf_dir):
    li = dirty_lineitem(spark, sf_dir)
    return union_rows([li, li.where(F.col("l_orderkey") % 50 == 0)])


LINEITEM_COPIES = f"(SELECT * FROM {DIRTY_LINEITEM} UNION ALL SELECT * FROM {DIRTY_LINEITEM} WHERE l_orderkey % 50 = 0)"


@query("p07_drop_duplicates", f"SELECT DISTINCT * FROM {LINEITEM_COPIES}")
def drop_duplicates(spark, sf_dir):
    return schema.drop_duplicate_rows(_with_copies(spark, sf_dir))


@query(
    "p08_top_categories",
    """SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_brand IN (
    SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)""",
)
def top_categories(spark, sf_dir):
    return schema.keep_top_categories(table(spark, sf_dir, "part"), "p_brand", 10).select("p_partkey", "p_brand", "p_retailprice")


@query(
    "p09_drop_bad_dates",
    f"SELECT o_orderkey, strptime(date_text, '%m/%d/%Y') AS date_text FROM {DIRTY_ORDERS} WHERE try_strptime(date_text, '%m/%d/%Y') IS NOT NULL",
)
def drop_bad_dates(spark, sf_dir):
    return schema.drop_bad_dates(dirty_orders(spark, sf_dir), "date_text", "MM/dd/yyyy").select("o_orderkey", "date_text")


@query(
    "p10_valid_transactions",
    "SELECT event_id, user_id, value FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, value - 5 AS value FROM events) WHERE user_id IS NOT NULL AND value > 0",
)
def valid_transactions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"), (F.col("value") - 5).alias("value")
    )
    return schema.valid_transactions(e, "user_id", "value")


@query(
    "p11_dtype_counts",
    f"""SELECT * FROM (VALUES ('int', 1::BIGINT, 0::BIGINT), ('bigint', 3, 0), ('string', 2, 0), ('timestamp_ntz', 1, 0)) AS t(dtype, n_columns, n_missing)
    UNION ALL SELECT 'double', 4, count(*) - count(l_quantity) FROM {DIRTY_LINEITEM}""",
)
def dtype_counts(spark, sf_dir):
    return profile.dtype_overview(dirty_lineitem(spark, sf_dir))


@query(
    "p12_semantic_types",
    """SELECT 'c_custkey' AS "column", 'numeric' AS semantic_type, count(*) AS n_rows, count(*) - count(c_custkey) AS n_null FROM customer
    UNION ALL SELECT 'c_name', CASE WHEN count(DISTINCT c_name) < count(*) * 0.5 THEN 'categorical' ELSE 'text' END, count(*), count(*) - count(c_name) FROM customer
    UNION ALL SELECT 'c_nationkey', 'numeric', count(*), count(*) - count(c_nationkey) FROM customer
    UNION ALL SELECT 'c_acctbal', 'numeric', count(*), count(*) - count(c_acctbal) FROM customer
    UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) < count(*) * 0.5 THEN 'categorical' ELSE 'text' END, count(*), count(*) - count(c_mktsegment) FROM customer""",
)
def semantic_types(spark, sf_dir):
    return schema.semantic_types(table(spark, sf_dir, "customer"))


@query(
    "p13_suggested_roles",
    """SELECT 'customer' AS role, 'e_user_id' AS "column", count(e_user_id) AS n_known FROM (SELECT user_id AS e_user_id FROM events)
    UNION ALL SELECT 'customer', 'event_id', count(event_id) FROM events
    UNION ALL SELECT 'date', 'event_time', count(ts) FROM events
    UNION ALL SELECT 'price', 'value', count(value) FROM events""",
)
def suggested_roles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("e_user_id"), F.col("ts").alias("event_time"), "value")
    return schema.role_table(e)


def _id_sql(col: str, named: bool, text: bool) -> str:
    pattern = (
        f"coalesce(bool_or(regexp_matches({col}, '[A-Za-z].*[0-9]|[0-9].*[A-Za-z]') OR regexp_matches({col}, '^[A-Za-z\\-]+[0-9]+$|^[0-9]+[-_/][0-9A-Za-z]+$')), false)"
        if text
        else "false"
    )
    return f"""SELECT '{col}' AS "column", count(DISTINCT {col}) / count(*) AS unique_ratio, {pattern} AS has_pattern, {'true' if named else 'false'} AS named FROM part"""


@query(
    "p14_id_like_columns",
    """SELECT "column", round(unique_ratio, 6) AS unique_ratio, has_pattern, reason IS NOT NULL AS is_id, reason FROM (SELECT *,
      CASE WHEN unique_ratio > 0.8 AND named THEN 'name' WHEN unique_ratio > 0.8 AND has_pattern THEN 'pattern' WHEN unique_ratio > 0.95 THEN 'unique' END AS reason FROM ("""
    + " UNION ALL ".join(
        [
            _id_sql("p_partkey", True, False),
            _id_sql("p_name", False, True),
            _id_sql("p_brand", False, True),
            _id_sql("p_type", False, True),
            _id_sql("p_size", False, False),
            _id_sql("p_retailprice", False, False),
        ]
    )
    + "))",
)
def id_like_columns(spark, sf_dir):
    return rounded(schema.id_like_columns(table(spark, sf_dir, "part")))


@query(
    "p15_likely_date_columns",
    f"""SELECT c AS "column", n AS n_rows, p AS n_parsed, p > 0 AND (n - p) / n < 0.5 AS is_date FROM (
    SELECT 'o_orderstatus' AS c, count(*) AS n, 0::BIGINT AS p FROM {DIRTY_ORDERS} UNION ALL
    SELECT 'o_orderpriority', count(*), 0 FROM {DIRTY_ORDERS} UNION ALL
    SELECT 'date_text', count(*), count(try_strptime(date_text, '%m/%d/%Y')) FROM {DIRTY_ORDERS})""",
)
def likely_date_columns(spark, sf_dir):
    o = dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority", "date_text")
    return schema.likely_date_columns(o)


def _cleaning_input(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    base = o.select(
        "o_orderkey",
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 7 != 0, F.when(key % 997 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice"))).alias("price"),
        F.format_string("%.2f", "o_totalprice").alias("price_text"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date_text"),
    )
    return union_rows([base, base.where(key % 50 == 0)])


# Fill values are rounded so that both engines remove and keep the same rows.
CLEANING_SQL = """WITH base AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 997 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS price,
 printf('%.2f', o_totalprice) AS price_text, strftime(o_orderdate, '%m/%d/%Y') AS date_text FROM orders),
doubled AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 50 = 0),
mode_p AS (SELECT priority AS m FROM doubled WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1),
filled AS (SELECT DISTINCT o_orderkey, coalesce(priority, (SELECT m FROM mode_p)) AS priority,
  coalesce(price, (SELECT avg(price) FROM doubled)) AS price, price_text, date_text FROM doubled),
s1 AS (SELECT avg(o_orderkey) AS m, stddev_samp(o_orderkey) AS s FROM filled),
f1 AS (SELECT * FROM filled, s1 WHERE abs((o_orderkey - m) / s) <= 3),
s2 AS (SELECT avg(price) AS m2, stddev_samp(price) AS sd2 FROM f1),
f2 AS (SELECT * FROM f1, s2 WHERE abs((price - m2) / sd2) <= 3)
"""


@query(
    "p16_cleaning_sequence",
    CLEANING_SQL
    + "SELECT o_orderkey, priority, round(price, 4) AS price, CAST(price_text AS DOUBLE) AS price_text, strptime(date_text, '%m/%d/%Y') AS date_text FROM f2",
)
def cleaning_sequence(spark, sf_dir):
    spec = cleaning.CleaningSpec(False, True, True, True, True, True, True)
    return rounded(cleaning.clean(_cleaning_input(spark, sf_dir), spec, report=False)[0], 4)


@query(
    "p17_cleaning_report",
    CLEANING_SQL
    + """SELECT 'fill_mean' AS step, 'price' AS "column", round((SELECT avg(price) FROM doubled), 4) AS number, NULL::VARCHAR AS detail
 UNION ALL SELECT 'fill_mode', 'priority', NULL, (SELECT m FROM mode_p)
 UNION ALL SELECT 'drop_duplicates', NULL, (SELECT count(*) FROM doubled) - (SELECT count(*) FROM filled), NULL
 UNION ALL SELECT 'remove_outliers', NULL, (SELECT count(*) FROM filled) - (SELECT count(*) FROM f2), NULL
 UNION ALL SELECT 'convert_numeric', 'price_text', NULL, NULL
 UNION ALL SELECT 'convert_datetime', 'date_text', NULL, NULL
 UNION ALL SELECT 'overall', NULL, (SELECT count(*) FROM doubled) - (SELECT count(*) FROM f2), (SELECT count(*) FROM f2) || ' rows remaining'""",
)
def cleaning_report(spark, sf_dir):
    spec = cleaning.CleaningSpec(False, True, True, True, True, True, True)
    return rounded(cleaning.clean(_cleaning_input(spark, sf_dir), spec)[1].drop("position"), 4)


# --- type conversion ---------------------------------------------------------------------


@query("t01_to_numeric", f"SELECT o_orderkey, TRY_CAST(price_text AS DOUBLE) AS price_text FROM {DIRTY_ORDERS}")
def to_numeric(spark, sf_dir):
    return convert.convert_columns(dirty_orders(spark, sf_dir).select("o_orderkey", "price_text"), {"price_text": "numeric"})


@query(
    "t02_to_int_float",
    "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(l_extendedprice AS BIGINT) END AS l_extendedprice, l_discount FROM lineitem",
)
def to_int_float(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_discount").cast("string").alias("l_discount")
    )
    return convert.convert_columns(li, {"l_quantity": "int", "l_extendedprice": "int", "l_discount": "float"})


@query("t03_to_datetime", f"SELECT o_orderkey, try_strptime(date_text, '%m/%d/%Y') AS date_text FROM {DIRTY_ORDERS}")
def to_datetime(spark, sf_dir):
    return convert.convert_columns(dirty_orders(spark, sf_dir).select("o_orderkey", "date_text"), {"date_text": "datetime"})


# Nine forms of one moment, and texts that are no date.
_MIXED_FORMS = ("MM/dd/yyyy HH:mm", "M/d/yyyy H:mm", "dd-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd HH:mm", "dd MMMM yyyy", "M/d/yy", "yyyy-MM-dd HH:mm:ss")


def _mixed_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_orderkey") % 24, mins=F.col("o_orderkey") % 60)
    text = F.lit("n/a")
    for i, form in enumerate(_MIXED_FORMS):
        text = F.when(F.col("o_orderkey") % 11 == i, F.date_format(ts, form)).otherwise(text)
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 10, "1234").otherwise(text).alias("d"))


_MIXED_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 IN (0, 1, 5, 8) THEN o_orderdate + to_hours((o_orderkey % 24)::INTEGER) + to_minutes((o_orderkey % 60)::INTEGER)
    WHEN o_orderkey % 11 < 9 THEN o_orderdate END::TIMESTAMP AS d FROM orders"""


@query("t03_to_datetime_mixed", _MIXED_SQL)
def to_datetime_mixed(spark, sf_dir):
    return convert.convert_columns(_mixed_dates(spark, sf_dir), {"d": "datetime"})


@query("t09_convert_mostly_one_pattern", "SELECT o_orderkey, CASE WHEN o_orderkey % 21 <> 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS d FROM orders")
def convert_mostly_one_pattern(spark, sf_dir):
    good = F.date_format("o_orderdate", "dd.MM.yyyy")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 21 == 0, "31.31.2024").otherwise(good).alias("d"))
    return convert.convert_datetime_columns(o, ["d"])


@query("t02_to_integer_large", "SELECT o_orderkey, o_orderkey + 9007199254740993 AS whole, o_orderkey + 9007199254740993 AS digits FROM orders")
def to_integer_large(spark, sf_dir):
    n = F.col("o_orderkey") + F.lit(9007199254740993)
    o = table(spark, sf_dir, "orders").select("o_orderkey", n.alias("whole"), n.cast("string").alias("digits"))
    return convert.convert_columns(o, {"whole": "int", "digits": "int"})


@query("s05_csv_text_round_trip", "SELECT doc_id, text || '\n\"quoted\", ' || lang AS text FROM documents")
def csv_text_round_trip(spark, sf_dir):
    path = _folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit('\n"quoted", '), "lang").alias("text"))
    files.write_csv(docs, path)
    return files.read_csv_any(spark, path, "doc_id bigint, text string")


@query("t04_to_datetime_strict", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS date_text FROM orders")
def to_datetime_strict(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("date_text"))
    return convert.to_datetime_strict(o, "date_text", "dd.MM.yyyy")


@query("t05_to_string", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_brand FROM part")
def to_string(spark, sf_dir):
    return convert.convert_columns(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), {"p_size": "string", "p_brand": "category"})


@query(
    "t06_auto_numeric",
    f"SELECT o_orderkey, price_text, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS clean_text, o_orderstatus FROM {DIRTY_ORDERS}",
)
def auto_numeric(spark, sf_dir):
    o = dirty_orders(spark, sf_dir).select("o_orderkey", "price_text", F.format_string("%.2f", "o_totalprice").alias("clean_text"), "o_orderstatus")
    return convert.auto_numeric(o)[0]


@query(
    "t07_auto_datetime",
    f"SELECT o_orderkey, date_text, o_orderdate AS clean_text, o_orderstatus FROM {DIRTY_ORDERS}",
)
def auto_datetime(spark, sf_dir):
    o = dirty_orders(spark, sf_dir).select("o_orderkey", "date_text", F.date_format("o_orderdate", "yyyy/MM/dd").alias("clean_text"), "o_orderstatus")
    return convert.auto_datetime(o)[0]


@query(
    "t08_date_patterns",
    "WITH d AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders) "
    + " UNION ALL ".join(f"SELECT '{p}' AS pattern, bool_and(try_strptime(d, '{_strptime(p)}') IS NOT NULL) AS matches FROM d" for p in convert.DATE_PATTERNS),
)
def date_patterns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    return convert.pattern_matches(o, "d").select("pattern", "matches")


@query("t09_convert_detected_dates", "SELECT o_orderkey, o_orderdate AS d1, o_orderdate AS d2 FROM orders")
def convert_detected_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd-MMM-yyyy").alias("d1"), F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss").alias("d2")
    )
    return convert.convert_datetime_columns(o, ["d1", "d2"])


@query("t10_numeric_by_name", "SELECT l_orderkey, l_quantity AS \"Quantity\", CAST(l_returnflag AS VARCHAR) AS flag, l_partkey AS stock_code FROM lineitem")
def numeric_by_name(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("string").alias("Quantity"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").cast("string").alias("stock_code")
    )
    return convert.coerce_by_name(li)


@query(
    "t11_strip_to_number",
    "SELECT c_custkey, TRY_CAST(regexp_replace(c_name, '[^0-9.-]', '', 'g') AS DOUBLE) AS c_name, c_acctbal AS money FROM customer",
)
def strip_to_number(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("$ "), F.format_string("%.2f", "c_acctbal")).alias("money"))
    return convert.strip_to_number(c, ["c_name", "money"])


@query(
    "t12_unconvertible_examples",
    f"""(SELECT 'price_text' AS "column", price_text AS example FROM {DIRTY_ORDERS} WHERE price_text IS NOT NULL AND TRY_CAST(price_text AS DOUBLE) IS NULL GROUP BY ALL ORDER BY 2 LIMIT 3)
    UNION ALL (SELECT 'date_text', date_text FROM {DIRTY_ORDERS} GROUP BY ALL ORDER BY 2 LIMIT 3)""",
)
def unconvertible_examples(spark, sf_dir):
    return convert.unconvertible_examples(dirty_orders(spark, sf_dir), ["price_text", "date_text"])


# --- missing values ----------------------------------------------------------------------


@query(
    "i01_mean_median_fill",
    f"""SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {DIRTY_LINEITEM})), 6) AS mean_filled,
    coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {DIRTY_LINEITEM})) AS median_filled FROM {DIRTY_LINEITEM}""",
)
def mean_median_fill(spark, sf_dir):
    li = dirty_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("mean_filled"), F.col("l_quantity").alias("median_filled"))
    return rounded(missing.fill_median(missing.fill_mean(li, ["mean_filled"]), ["median_filled"]))


@query(
    "i02_mode_fill",
    f"""SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {DIRTY_ORDERS} WHERE o_orderpriority IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM {DIRTY_ORDERS}""",
)
def mode_fill(spark, sf_dir):
    return missing.fill_mode(dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("i03_zero_fill", f"SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0.0) AS l_quantity FROM {DIRTY_LINEITEM}")
def zero_fill(spark, sf_dir):
    return missing.fill_zero(dirty_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])


def _gappy_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_type", "event_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


GAPPY_EVENTS = "(SELECT event_type, event_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events)"


@query(
    "i04_forward_backward_fill",
    f"""SELECT event_type, event_id, ts, coalesce(
    last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM {GAPPY_EVENTS}""",
)
def forward_backward_fill(spark, sf_dir):
    return missing.fill_forward_backward(_gappy_events(spark, sf_dir), ["event_type"], "ts", "event_id", "value")


@query(
    "i07_missing_report",
    f"""SELECT "column", n_missing, round(n_missing * 100.0 / n, 6) AS pct_missing FROM (SELECT 'o_orderpriority' AS "column", count(*) - count(o_orderpriority) AS n_missing, count(*) AS n FROM {DIRTY_ORDERS})""",
)
def missing_report(spark, sf_dir):
    return rounded(missing.missing_report(dirty_orders(spark, sf_dir)))


@query(
    "i08_missing_cells",
    f"""SELECT count(*) - count(o_orderpriority) AS missing_cells, count(*) * 8 AS total_cells, round((count(*) - count(o_orderpriority)) * 100.0 / (count(*) * 8), 6) AS pct_missing FROM {DIRTY_ORDERS}""",
)
def missing_cells(spark, sf_dir):
    return rounded(missing.missing_cells(dirty_orders(spark, sf_dir)))


@query(
    "i09_linear_interpolation",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM {GAPPY_EVENTS}),
    k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pp, last_value(value IGNORE NULLS) OVER b AS pv,
     first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER f AS np, first_value(value IGNORE NULLS) OVER f AS nv FROM n
     WINDOW b AS (PARTITION BY event_type ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            f AS (PARTITION BY event_type ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_type, event_id, ts, round(CASE WHEN value IS NOT NULL THEN value WHEN pv IS NOT NULL AND nv IS NOT NULL
      THEN pv + (nv - pv) * ((p - pp) / (np - pp)) ELSE pv END, 6) AS value FROM k""",
)
def linear_interpolation(spark, sf_dir):
    return rounded(missing.fill_linear(_gappy_events(spark, sf_dir), ["event_type"], "ts", "event_id", "value"))


@query("i06_iterative_fill")
def iterative_fill(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    gappy = li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(key % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(key % 5 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount",
    )
    return rounded(missing.fill_iterative(gappy, ["l_quantity", "l_extendedprice", "l_discount"]))


# --- outliers ----------------------------------------------------------------------------


@query(
    "o01_zscore_removal",
    f"""WITH s1 AS (SELECT avg(c_acctbal) AS m1, stddev_samp(c_acctbal) AS d1 FROM {OUTLIER_CUSTOMERS}),
    f1 AS (SELECT c.* FROM {OUTLIER_CUSTOMERS} c, s1 WHERE abs((c_acctbal - m1) / d1) <= 3),
    s2 AS (SELECT avg(c_nationkey) AS m2, stddev_samp(c_nationkey) AS d2 FROM f1)
    SELECT f1.* FROM f1, s2 WHERE abs((c_nationkey - m2) / d2) <= 3""",
)
def zscore_removal(spark, sf_dir):
    return outliers.remove_zscore_outliers(outlier_customers(spark, sf_dir), ["c_acctbal", "c_nationkey"])


@query(
    "o02_iqr_report",
    f"""WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3, count(*) AS n FROM {OUTLIER_CUSTOMERS})
    SELECT 'c_acctbal' AS "column", count(*) AS n_outliers, round(count(*) * 100.0 / max(n), 6) AS pct_outliers, min(c_acctbal) AS min_outlier, max(c_acctbal) AS max_outlier
    FROM {OUTLIER_CUSTOMERS}, q WHERE c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1)""",
)
def iqr_report(spark, sf_dir):
    return rounded(outliers.iqr_report(outlier_customers(spark, sf_dir), ["c_acctbal", "c_nationkey"]))


@query("o03_isolation_flags")
def isolation_flags(spark, sf_dir):
    return outliers.flag_isolated(outlier_customers(spark, sf_dir), ["c_acctbal", "c_nationkey"], 0.1)


@query(
    "o04_winsorise",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () AS n FROM {OUTLIER_CUSTOMERS}),
    b AS (SELECT max(CASE WHEN rn = floor(0.05 * n) + 1 THEN c_acctbal END) AS lo, max(CASE WHEN rn = n - floor(0.05 * n) THEN c_acctbal END) AS hi FROM r)
    SELECT c_custkey, least(greatest(c_acctbal, lo), hi) AS c_acctbal FROM {OUTLIER_CUSTOMERS}, b""",
)
def winsorise(spark, sf_dir):
    return outliers.winsorise(outlier_customers(spark, sf_dir), ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("p00_nan_to_null", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events")
def nan_entry_rule(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return nan_to_null(e)
