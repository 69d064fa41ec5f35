"""Revenue reconciliation: raw delivered item revenue against each mart's total.

The expected side reads the raw tables directly (only the join keys are
normalised), so it is independent of the fact models.  Item rows cross the
network once, to meet their orders; then they are summed per key of each mart
(map side first), and only these sums meet the keys of the dimensions: seller and
geography keep keys that exist.  A seller with a third of all items is one row
of the semi join.  One-row totals are stacked and folded by mart -- no cross join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions import clean_id

AMOUNT = "decimal(38,2)"
EVERY_ITEM = "all"


def delivered_items(raw_items: DataFrame, raw_orders: DataFrame) -> DataFrame:
    items = raw_items.select(
        clean_id("order_id").alias("order_id"),
        clean_id("seller_id").alias("seller_id"),
        "price",
    )
    orders = raw_orders.where(F.col("order_status") == "delivered").select(
        clean_id("order_id").alias("order_id"), clean_id("customer_id").alias("customer_id")
    )
    return items.join(orders, "order_id")


def _total(df: DataFrame, column: str, mart: str, kind: str) -> DataFrame:
    return df.agg(F.sum(column).cast(AMOUNT).alias("amount")).select(
        F.lit(mart).alias("mart"), F.lit(kind).alias("kind"), "amount"
    )


def reconcile_detail(raw: Mapping[str, DataFrame], models: Mapping[str, DataFrame]) -> DataFrame:
    """One row per mart: ``mart, actual, expected``."""
    di = delivered_items(raw["order_items"], raw["orders"])
    # One row per mart and key; the category mart keeps every item (one constant key).
    keys = F.expr(
        "inline(array(struct('seller' as mart, seller_id as key), struct('geography' as mart, customer_id as key),"
        f" struct('category' as mart, '{EVERY_ITEM}' as key)))"
    )
    per_key = di.select("price", keys).groupBy("mart", "key").agg(F.sum("price").alias("amount"))
    spark = di.sparkSession
    known = (
        models["dim_sellers"].select(F.lit("seller").alias("mart"), F.col("seller_id").alias("key"))
        .unionByName(models["dim_customers"].select(F.lit("geography").alias("mart"), F.col("customer_id").alias("key")))
        .unionByName(spark.range(1).select(F.lit("category").alias("mart"), F.lit(EVERY_ITEM).alias("key")))
    )
    expected = per_key.join(known, ["mart", "key"], "left_semi").select("mart", F.lit("expected").alias("kind"), "amount")
    parts = [
        _total(models["mart_seller_performance"], "total_revenue", "seller", "actual"),
        _total(models["mart_category_performance"], "total_revenue", "category", "actual"),
        _total(models["mart_geography_sales"], "total_revenue", "geography", "actual"),
        expected.groupBy("mart", "kind").agg(F.sum("amount").cast(AMOUNT).alias("amount")),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    zero = F.lit(0).cast(AMOUNT)
    return stacked.groupBy("mart").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "actual", F.col("amount"))), zero).alias(
            "actual"
        ),
        F.coalesce(F.max(F.when(F.col("kind") == "expected", F.col("amount"))), zero).alias(
            "expected"
        ),
    )


def reconcile_revenue(raw: Mapping[str, DataFrame], models: Mapping[str, DataFrame]) -> DataFrame:
    """Rows where a mart's total is distinct from the raw delivered revenue (empty = pass)."""
    detail = reconcile_detail(raw, models)
    return detail.where(~F.col("actual").eqNullSafe(F.col("expected")))
