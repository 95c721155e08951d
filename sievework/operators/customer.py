"""Customer value: recency, frequency, monetary scores and lifetime value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import parse_datetime_any, text_columns, to_double
from sievework.functions.order_stats import grouped_quantiles
from sievework.operators.encode import one_hot, quantile_bins_many
from sievework.operators.missing import fill_mean
from sievework.operators.profile import describe, whole_days
from sievework.operators.schema import valid_transactions
from sievework.session import cut_lineage

# Lowest score of each segment.
SEGMENTS = ((13, "Champions"), (10, "Loyal Customers"), (7, "Potential Loyalists"), (4, "At Risk"))
LOWEST_SEGMENT = "Lost"
DAYS_PER_YEAR = 365


def rfm(df: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    """Days since the customer's last date, number of rows, sum of amounts."""
    latest = df.agg(F.max(date)).scalar()
    per = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(
        F.max(date).alias("_last"), F.count(F.lit(1)).alias("frequency"), F.sum(amount).alias("monetary")
    )
    return per.select(customer, whole_days(F.col("_last"), latest).alias("recency"), "frequency", "monetary")


def simple_clv(rfm_table: DataFrame) -> DataFrame:
    """Order value x frequency x 365 / recency, where a recency of 0 counts as 1."""
    recency = F.when(F.col("recency") == 0, 1).otherwise(F.col("recency"))
    order_value = F.col("monetary") / F.col("frequency")
    return rfm_table.withColumn("recency", recency).withColumn(
        "clv", order_value * F.col("frequency") * (F.lit(DAYS_PER_YEAR) / F.col("recency"))
    )


def clv_summary(clv: DataFrame) -> DataFrame:
    return clv.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.avg("clv").alias("average_clv"),
        F.sum("monetary").alias("total_revenue"),
        F.try_divide(F.sum("monetary"), F.sum("frequency")).alias("average_order_value"),
    )


def customer_table(
    df: DataFrame, customer: str, date: str, quantity: str, price: str, country: str | None = None
) -> DataFrame:
    """One row per customer (and country) over valid transactions."""
    keys = [customer] + ([country] if country else [])
    text = set(text_columns(df))
    number = {c: to_double(c) if c in text else F.col(c).cast("double") for c in (quantity, price)}
    when = parse_datetime_any(date) if date in text else F.col(date)
    rows = df.select(*keys, when.alias("_d"), (number[quantity] * number[price]).alias("_amount"))
    rows = valid_transactions(rows, customer, "_amount")
    # Written once: the last date of all is read from the reduced table, not from the rows again.
    per = cut_lineage(
        rows.groupBy(*keys).agg(
            F.sum("_amount").alias("total_revenue"),
            F.count("_d").alias("frequency"),
            F.min("_d").alias("first_purchase"),
            F.max("_d").alias("last_purchase"),
        )
    )
    latest = per.agg(F.max("last_purchase")).scalar()
    return per.withColumns(
        {
            "average_order_value": F.try_divide("total_revenue", "frequency"),
            "customer_lifespan": whole_days(F.col("first_purchase"), F.col("last_purchase")),
            "recency": whole_days(F.col("last_purchase"), latest),
            "historical_clv": F.col("total_revenue"),
        }
    )


def score_rfm(table: DataFrame) -> DataFrame:
    """Quintile scores 1-5, five for the most recent, most frequent, highest revenue."""
    up, down = [1, 2, 3, 4, 5], [5, 4, 3, 2, 1]
    scored = quantile_bins_many(
        table,
        {"recency": down, "frequency": up, "total_revenue": up},
        5,
        {"recency": "recency_score", "frequency": "frequency_score", "total_revenue": "monetary_score"},
    )
    return scored.withColumn("rfm_score", F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score"))


def add_segment(scored: DataFrame) -> DataFrame:
    label = F.lit(LOWEST_SEGMENT)
    for lowest, name in reversed(SEGMENTS):
        label = F.when(F.col("rfm_score") >= lowest, name).otherwise(label)
    return scored.withColumn("segment", label)


def segment_stats(segmented: DataFrame) -> DataFrame:
    means = segmented.groupBy("segment").agg(
        F.round(F.avg("historical_clv"), 2).alias("average_clv"),
        F.round(F.sum("historical_clv"), 2).alias("total_clv"),
        F.count("historical_clv").alias("customer_count"),
        F.round(F.avg("frequency"), 2).alias("average_frequency"),
        F.round(F.avg("recency"), 2).alias("average_recency_days"),
        F.round(F.sum("total_revenue"), 2).alias("total_revenue"),
    )
    medians = grouped_quantiles(segmented, ["segment"], "historical_clv", [0.5], ["median_clv"])
    return means.join(medians.withColumn("median_clv", F.round("median_clv", 2)), "segment")


def clv_description(table: DataFrame) -> DataFrame:
    return describe(table, ["historical_clv", "average_order_value", "frequency", "customer_lifespan", "recency"])


def regression_features(table: DataFrame, as_of: str, country: str | None = None) -> DataFrame:
    """Model inputs per customer; days are counted up to the ``as_of`` timestamp."""
    now = F.lit(as_of).cast("timestamp_ntz")
    out = table.withColumns(
        {
            "days_since_first_purchase": whole_days(F.col("first_purchase"), now),
            "days_since_last_purchase": whole_days(F.col("last_purchase"), now),
        }
    )
    numbers = [
        "frequency",
        "average_order_value",
        "customer_lifespan",
        "recency",
        "days_since_first_purchase",
        "days_since_last_purchase",
    ]
    keep = [c for c in table.columns if c not in ("total_revenue", "first_purchase", "last_purchase", *numbers)]
    out = out.select(*keep, *[F.col(c).cast("double").alias(c) for c in numbers])
    if country:
        # Fold over the levels the table really has.
        out = one_hot(out.withColumnRenamed(country, "country"), "country", drop_first=False, limit=None)
    return fill_mean(out, numbers)


def top_customers(clv: DataFrame, customer: str, n: int = 10, by: str = "clv") -> DataFrame:
    return clv.orderBy(F.desc(by), customer).limit(n)
