"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is left out where SQL cannot say it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; adding 0.0 turns a negative zero into zero."""

    def one(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return (F.round(F.col(f"`{name}`").cast("double"), special.get(name, digits)) + F.lit(0.0)).alias(name)
        return F.col(f"`{name}`")

    return df.select(*[one(n, k) for n, k in df.dtypes])


# --- injected defects, the same rule in Spark and in SQL ---------------------------------


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))


DIRTY_LINEITEM = (
    "(SELECT * REPLACE (CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem)"
)


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL priorities, numbers as text with 'n/a', dates as text with impossible ones."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(key % 17 == 0, "n/a")
        .otherwise(F.format_string("%.2f", "o_totalprice"))
        .alias("price_text"),
        F.when(key % 13 == 0, "13/45/2024")
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
        .alias("date_text"),
        "o_totalprice",
        "o_orderdate",
    )


DIRTY_ORDERS = """(SELECT o_orderkey, o_custkey, o_orderstatus,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
 CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE printf('%.2f', o_totalprice) END AS price_text,
 CASE WHEN o_orderkey % 13 = 0 THEN '13/45/2024' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date_text,
 o_totalprice, o_orderdate FROM orders)"""


def outlier_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances, a hundred times too large where the key is a multiple of 97."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        "c_nationkey",
        F.when(F.col("c_custkey") % 97 == 0, F.col("c_acctbal") * 100)
        .otherwise(F.col("c_acctbal"))
        .alias("c_acctbal"),
        "c_mktsegment",
    )


OUTLIER_CUSTOMERS = """(SELECT c_custkey, c_nationkey,
 CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"""
