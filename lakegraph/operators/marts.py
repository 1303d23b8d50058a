"""The gold tables of the sample medallion flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def exact_sum(amount: Column, scale: int = 2) -> Column:
    """Sum of money as decimals, so that it does not depend on row order."""
    return F.sum(amount.cast(f"decimal(28,{scale})")).cast("double")


def daily_totals(orders: DataFrame, ts: str, key: str, amount: str) -> DataFrame:
    """``order_date, key, order_count, gross_revenue``."""
    return orders.groupBy(F.to_date(ts).alias("order_date"), key).agg(
        F.count(F.lit(1)).alias("order_count"), exact_sum(F.col(amount)).alias("gross_revenue")
    )


def lifetime_value(orders: DataFrame, customer: str, amount: str) -> DataFrame:
    """``customer, lifetime_value, order_count``."""
    return orders.groupBy(customer).agg(
        exact_sum(F.col(amount)).alias("lifetime_value"), F.count(F.lit(1)).alias("order_count")
    )


def full_load(incoming: DataFrame, path: str) -> None:
    """A snapshot that replaces its target."""
    incoming.write.mode("overwrite").parquet(path)
