"""Gold dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions import clean_id, delay_days
from tradelens.operators.dedup import first_per_key
from tradelens.plans.silver import ORDER_TIMESTAMPS

PRODUCT_ATTRIBUTES = (
    "product_name_length",
    "product_description_length",
    "product_photos_qty",
    "product_weight_g",
    "product_length_cm",
    "product_height_cm",
    "product_width_cm",
)


def dim_customers(raw_customers: DataFrame) -> DataFrame:
    cleaned = raw_customers.select(
        clean_id("customer_id").alias("customer_id"),
        clean_id("customer_unique_id").alias("customer_unique_id"),
        clean_id("customer_city").alias("customer_city"),
        clean_id("customer_state").alias("customer_state"),
    ).where("customer_id IS NOT NULL")
    return first_per_key(
        cleaned, ["customer_id"], ["customer_unique_id", "customer_city", "customer_state"]
    )


def dim_sellers(raw_sellers: DataFrame) -> DataFrame:
    cleaned = raw_sellers.select(
        clean_id("seller_id").alias("seller_id"),
        clean_id("seller_city").alias("seller_city"),
        clean_id("seller_state").alias("seller_state"),
    ).where("seller_id IS NOT NULL")
    return first_per_key(cleaned, ["seller_id"], ["seller_city", "seller_state"])


def dim_products(raw_products: DataFrame, category_translation: DataFrame) -> DataFrame:
    """Products with the English label when one exists, else the source label.

    The translation side holds one row per category label, so AQE turns the join
    into a broadcast from runtime statistics when it is small; no hint is forced.
    """
    cleaned = raw_products.select(
        clean_id("product_id").alias("product_id"),
        clean_id("product_category_name").alias("source_product_category_name"),
        F.col("product_name_lenght").alias("product_name_length"),
        F.col("product_description_lenght").alias("product_description_length"),
        *PRODUCT_ATTRIBUTES[2:],
    ).where("product_id IS NOT NULL")
    translated = cleaned.join(
        category_translation.withColumnRenamed(
            "product_category_name", "source_product_category_name"
        ),
        "source_product_category_name",
        "left",
    )
    shaped = translated.select(
        "product_id",
        F.coalesce("product_category_name_english", "source_product_category_name").alias(
            "product_category_name"
        ),
        "product_category_name_english",
        "source_product_category_name",
        *PRODUCT_ATTRIBUTES,
    )
    return first_per_key(
        shaped,
        ["product_id"],
        ["product_category_name_english", "source_product_category_name", *PRODUCT_ATTRIBUTES],
    )


def fact_orders(silver_orders: DataFrame, review_summary: DataFrame) -> DataFrame:
    """One row per order with delay, delivery flags (three-valued) and mean review."""
    both_known = (
        "order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL"
    )
    return silver_orders.join(review_summary, "order_id", "left").select(
        "order_id",
        "customer_id",
        "order_status",
        *ORDER_TIMESTAMPS,
        delay_days("order_delivered_customer_date", "order_estimated_delivery_date").alias(
            "delivery_delay_days"
        ),
        F.expr("order_status = 'delivered'").alias("is_delivered"),
        F.expr(
            f"{both_known} AND order_delivered_customer_date > order_estimated_delivery_date"
        ).alias("is_late_delivery"),
        F.expr(f"order_status = 'delivered' AND {both_known}").alias("has_delivery_outcome"),
        "avg_review_score",
    )


def fact_order_items(silver_items: DataFrame, payment_summary: DataFrame) -> DataFrame:
    """Item rows plus item total and the whole order's payment total (repeats per item)."""
    return silver_items.join(payment_summary, "order_id", "left").select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        "price",
        "freight_value",
        F.expr("price + freight_value").alias("item_total_value"),
        F.col("total_payment_value").alias("order_total_payment_value"),
    )
