"""Documented analysis queries over the marts and facts (E1-E5, F1-F3)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions import exact_mean, exact_ratio


def top5_sellers(models: Mapping[str, DataFrame]) -> DataFrame:
    return (
        models["mart_seller_performance"]
        .select("seller_id", "seller_state", "total_orders", "total_revenue", "avg_review_score")
        .orderBy(F.col("total_revenue").desc_nulls_last(), F.col("seller_id").asc_nulls_last())
        .limit(5)
    )


def category_mix(models: Mapping[str, DataFrame]) -> DataFrame:
    return (
        models["mart_category_performance"]
        .select(
            "product_category",
            "total_orders",
            "total_items_sold",
            "total_revenue",
            "late_delivery_rate",
        )
        .orderBy(
            F.col("total_revenue").desc_nulls_last(), F.col("product_category").asc_nulls_last()
        )
        .limit(5)
    )


def state_revenue(models: Mapping[str, DataFrame], limit: int = 5) -> DataFrame:
    return (
        models["region_totals"]
        .groupBy("customer_state")
        .agg(
            F.expr("cast(sum(n_orders) as bigint)").alias("delivered_orders"),
            F.round(F.sum("revenue"), 2).alias("item_revenue"),
        )
        .where("delivered_orders > 0")
        .orderBy(
            F.col("item_revenue").desc_nulls_last(), F.col("customer_state").asc_nulls_last()
        )
        .limit(limit)
    )


def review_by_lateness(models: Mapping[str, DataFrame]) -> DataFrame:
    return (
        models["fact_orders"]
        .where("has_delivery_outcome AND avg_review_score IS NOT NULL")
        .groupBy("is_late_delivery")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            exact_mean("avg_review_score", 2).alias("avg_review_score"),
        )
    )


def freight_share(models: Mapping[str, DataFrame]) -> DataFrame:
    delivered = models["fact_orders"].where("is_delivered").select("order_id")
    items = models["fact_order_items"].select("order_id", "price", "freight_value")
    joined = items.join(delivered, "order_id")
    return joined.agg(
        F.round(F.sum("price"), 2).alias("item_revenue"),
        F.round(F.sum("freight_value"), 2).alias("freight"),
        exact_ratio("sum(freight_value) * 100", "sum(price)", 2).alias(
            "freight_pct_of_items"
        ),
    )


def late_rate(models: Mapping[str, DataFrame]) -> DataFrame:
    eligible = models["fact_orders"].where("has_delivery_outcome")
    return eligible.agg(
        F.expr("count(1)").alias("eligible_orders"),
        F.expr("count_if(is_late_delivery)").alias("late_orders"),
        exact_ratio("count_if(is_late_delivery) * 100", "count(1)", 2).alias("late_pct"),
    )


def top10_share(models: Mapping[str, DataFrame], k: int = 10) -> DataFrame:
    """Revenue of the top ``k`` sellers and their share of all mart revenue.

    An unpartitioned ``row_number`` would pull every seller into one task; the
    top ``k`` is a ``TakeOrderedAndProject`` (per-partition top-k, then merge)
    and the total a global aggregate; the two one-row results are stacked and
    folded into one row.
    """
    mart = models["mart_seller_performance"]
    top = (
        mart.orderBy(F.col("total_revenue").desc_nulls_last(), F.col("seller_id").asc_nulls_last())
        .limit(k)
        .agg(F.sum("total_revenue").alias("top_revenue"))
    )
    total = mart.agg(F.sum("total_revenue").alias("all_revenue"))
    both = top.unionByName(total, allowMissingColumns=True).agg(
        F.max("top_revenue").alias("top_revenue"), F.max("all_revenue").alias("all_revenue")
    )
    return both.select(
        F.round("top_revenue", 2).alias("top10_revenue"),
        exact_ratio("top_revenue * 100", "all_revenue", 2).alias("top10_pct"),
    )


def late_rate_by_state(
    models: Mapping[str, DataFrame], min_eligible: int = 500, limit: int = 5
) -> DataFrame:
    return (
        models["region_totals"]
        .groupBy("customer_state")
        .agg(
            F.expr("cast(sum(n_eligible) as bigint)").alias("eligible"),
            exact_ratio("sum(n_late)", "sum(n_eligible)", 4).alias("late_rate"),
        )
        .where(F.col("eligible") >= min_eligible)
        .orderBy(F.col("late_rate").desc_nulls_last(), F.col("customer_state").asc_nulls_last())
        .limit(limit)
    )
