"""Silver models: cleaned raw rows and per-order summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions import clean_id, exact_avg
from tradelens.operators.dedup import first_per_key

ORDER_TIMESTAMPS = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)


def orders(raw_orders: DataFrame) -> DataFrame:
    """One row per raw order with a non-blank id (not deduplicated: a test catches it)."""
    return raw_orders.select(
        clean_id("order_id").alias("order_id"),
        clean_id("customer_id").alias("customer_id"),
        "order_status",
        *ORDER_TIMESTAMPS,
    ).where("order_id IS NOT NULL")


def order_items(raw_items: DataFrame) -> DataFrame:
    """Item rows with cleaned keys; ``shipping_limit_date`` is not carried on."""
    return raw_items.select(
        clean_id("order_id").alias("order_id"),
        "order_item_id",
        clean_id("product_id").alias("product_id"),
        clean_id("seller_id").alias("seller_id"),
        "price",
        "freight_value",
    ).where("order_id IS NOT NULL")


def category_translation(raw_translation: DataFrame) -> DataFrame:
    """One English label per source label; a NULL English label loses to any other."""
    cleaned = raw_translation.select(
        clean_id("product_category_name").alias("product_category_name"),
        clean_id("product_category_name_english").alias("product_category_name_english"),
    ).where("product_category_name IS NOT NULL")
    return first_per_key(cleaned, ["product_category_name"], ["product_category_name_english"])


def order_payment_summary(raw_payments: DataFrame) -> DataFrame:
    """Total of every payment component per order (no dedup of components)."""
    return (
        raw_payments.select(clean_id("order_id").alias("order_id"), "payment_value")
        .where("order_id IS NOT NULL")
        .groupBy("order_id")
        .agg(F.sum("payment_value").alias("total_payment_value"))
    )


def order_review_summary(raw_reviews: DataFrame) -> DataFrame:
    """Mean of the non-NULL scores per order; repeated review ids all count."""
    return (
        raw_reviews.select(clean_id("order_id").alias("order_id"), "review_score")
        .where("order_id IS NOT NULL")
        .groupBy("order_id")
        .agg(exact_avg("review_score").alias("avg_review_score"))
    )


def order_item_summary(silver_items: DataFrame) -> DataFrame:
    """Item revenue and freight per order."""
    return silver_items.groupBy("order_id").agg(
        F.sum("price").alias("revenue"), F.sum("freight_value").alias("freight")
    )
