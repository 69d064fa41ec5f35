"""Marts: seller, category and regional sales with their proper weights.

Item rows are reduced to (dimension, order) totals before the order-level
metrics are averaged, so reviews and lateness are order-weighted, prices of
the category mart item-weighted, and averages never average averages.  Every
aggregate is partial + final (a hot seller, category or order is combined map
side before it is shuffled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions import exact_mean, exact_ratio, flag_rate, mean_of_sums, wide_sum
from tradelens.operators.hot_keys import lookup_join
from tradelens.sinks.files import input_bytes

UNKNOWN_CATEGORY = "unknown"
#: Bytes of input files per partition of items dealt by order (about 200 MB in a task's memory).
PART_BYTES = 8 << 20

_FACT_COLUMNS = (
    "order_id",
    "avg_review_score",
    "delivery_delay_days",
    "is_late_delivery",
    "has_delivery_outcome",
)


def delivered_orders(fact_orders: DataFrame, *extra: str) -> DataFrame:
    """Delivered orders with the per-order columns the marts weight by."""
    return fact_orders.where("is_delivered").select(*_FACT_COLUMNS, *extra)


def order_parts(items: DataFrame) -> int | None:
    """Partitions that keep a task's totals per (dimension, order) small; None where one task could hold all."""
    n_bytes = input_bytes(items)
    if n_bytes <= PART_BYTES:
        return None
    least = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-n_bytes // PART_BYTES))


def by_order(fact_order_items: DataFrame, *columns: str) -> DataFrame:
    """Item rows dealt by order: the totals per (dimension, order) and the join with the
    orders that follows need no further exchange of item rows.

    Nearly every item is a group of its own, so a task holds its whole partition in
    the aggregate and again in the join's sort.  The number of partitions is given:
    AQE would merge them until each core has one (up to its advisory size of shuffled,
    compressed bytes, some thirty times as large in memory).  It may do so only where
    the whole input is one partition's worth.
    """
    items = fact_order_items.select("order_id", *columns)
    parts = order_parts(items)
    return items.repartition("order_id") if parts is None else items.repartition(parts, "order_id")


def _seller_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("seller_id", "order_id").agg(
        F.expr("count(1)").alias("total_items"),
        F.sum("price").alias("revenue"),
        F.sum("freight_value").alias("freight"),
    )


def seller_orders(fact_order_items: DataFrame) -> DataFrame:
    """Items, revenue and freight per (seller, order)."""
    return _seller_totals(fact_order_items)


def _with_category(items: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Items with their product's category; frequent and missing products are not shuffled."""
    known = lookup_join(items, dim_products, "product_id", ["product_category_name"])
    return known.select(
        F.expr(f"coalesce(product_category_name, '{UNKNOWN_CATEGORY}')").alias("product_category"),
        "order_id",
        "price",
    )


def _category_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("product_category", "order_id").agg(
        F.expr("count(1)").alias("total_items"),
        F.count("price").alias("priced_items"),
        F.sum("price").alias("revenue"),
    )


def category_orders(fact_order_items: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Items, priced items and revenue per (category, order); no product -> ``unknown``."""
    items = fact_order_items.select("order_id", "product_id", "price")
    return _category_totals(_with_category(items, dim_products))


def mart_seller_performance(
    dim_sellers: DataFrame, fact_orders: DataFrame, fact_order_items: DataFrame
) -> DataFrame:
    """Per seller: orders, items, revenue, order-weighted means and late rate.

    Items are shuffled by ``order_id`` once; the (seller, order) totals and the
    join with the delivered orders reuse that partitioning.  Grouping comes
    before the join, so an order row that occurs twice counts twice, as in the
    source system's view.
    """
    items = by_order(fact_order_items, "seller_id", "price", "freight_value")
    per_order = _seller_totals(items).join(delivered_orders(fact_orders), "order_id")
    # Aggregate per seller *before* meeting the dimension: a seller with a large
    # share of all orders is combined map side (partial aggregate) instead of
    # landing in one join task, and the join sees one row per seller.  Same
    # result: city and state depend on seller_id only (one row per seller after
    # dedup) and the inner join only filters.
    per_seller = per_order.groupBy("seller_id").agg(
        F.expr("count(1)").alias("total_orders"),
        F.expr("cast(sum(total_items) as bigint)").alias("total_items_sold"),
        F.expr("coalesce(sum(revenue), 0.00BD)").alias("total_revenue"),
        exact_mean("revenue", 2).alias("avg_order_value"),
        exact_mean("freight", 2).alias("avg_freight_value"),
        exact_mean("avg_review_score", 2).alias("avg_review_score"),
        exact_mean("CASE WHEN has_delivery_outcome THEN delivery_delay_days END", 2).alias(
            "avg_delivery_delay_days"
        ),
        flag_rate("is_late_delivery", "has_delivery_outcome").alias("late_delivery_rate"),
    )
    # per_seller on the left: a filter on seller_id (a keyed lookup) then pushes
    # through both aggregates into the item scan.
    return per_seller.join(dim_sellers, "seller_id").select(
        "seller_id",
        "seller_city",
        "seller_state",
        "total_orders",
        "total_items_sold",
        "total_revenue",
        "avg_order_value",
        "avg_freight_value",
        "avg_review_score",
        "avg_delivery_delay_days",
        "late_delivery_rate",
    )


def mart_category_performance(
    dim_products: DataFrame, fact_orders: DataFrame, fact_order_items: DataFrame
) -> DataFrame:
    """Per category: orders, items, revenue, item-weighted price, order-weighted means.

    Two shuffles of item rows at most: by product (without frequent and missing
    products) and by order, which serves the (category, order) totals and the
    join with the delivered orders.
    """
    items = fact_order_items.select("order_id", "product_id", "price")
    totals = _category_totals(by_order(_with_category(items, dim_products), "product_category", "price"))
    joined = totals.join(delivered_orders(fact_orders), "order_id")
    return joined.groupBy("product_category").agg(
        F.expr("count(1)").alias("total_orders"),
        F.expr("cast(sum(total_items) as bigint)").alias("total_items_sold"),
        F.expr("coalesce(sum(revenue), 0.00BD)").alias("total_revenue"),
        exact_ratio("sum(revenue)", "sum(priced_items)", 2).alias("avg_price"),
        exact_mean("avg_review_score", 2).alias("avg_review_score"),
        flag_rate("is_late_delivery", "has_delivery_outcome").alias("late_delivery_rate"),
    )


def region_totals(dim_customers: DataFrame, fact_orders: DataFrame, order_item_summary: DataFrame) -> DataFrame:
    """Exact, mergeable sums and counts of delivered orders per (state, city).

    Every regional answer (the geography mart, states, revenue and late rate by
    state) is a sum over these rows, so they are published and nothing rescans
    orders.  ``n_orders`` counts orders with items, ``n_eligible`` and ``n_late``
    all delivered ones.  Orders are aggregated per customer *before* the customer
    dimension is joined: a customer with a large share of all orders is combined
    map side and the join sees one row per customer.
    """
    fo = fact_orders.where("is_delivered").select(
        "order_id", "customer_id", "avg_review_score", "has_delivery_outcome", "is_late_delivery"
    )
    items = order_item_summary.select("order_id", "revenue", "freight", F.lit(True).alias("has_items"))
    per_customer = (
        fo.join(items, "order_id", "left")
        .groupBy("customer_id")
        .agg(
            F.expr("count(has_items)").alias("n_orders"),
            F.sum("revenue").alias("revenue"),
            wide_sum("revenue + freight").alias("ticket_sum"),
            F.expr("count(revenue + freight)").alias("ticket_n"),
            wide_sum("CASE WHEN has_items THEN avg_review_score END").alias("review_sum"),
            F.expr("count(CASE WHEN has_items THEN avg_review_score END)").alias("review_n"),
            F.expr("count_if(has_delivery_outcome)").alias("n_eligible"),
            F.expr("count_if(is_late_delivery)").alias("n_late"),
        )
    )
    customers = dim_customers.select("customer_id", "customer_state", "customer_city")
    return per_customer.join(customers, "customer_id").groupBy("customer_state", "customer_city").agg(
        *[
            F.expr(f"cast(sum({c}) as {kind})").alias(c)
            for c, kind in (
                ("n_orders", "bigint"), ("revenue", "decimal(38,2)"), ("ticket_sum", "decimal(38,14)"),
                ("ticket_n", "bigint"), ("review_sum", "decimal(38,14)"), ("review_n", "bigint"),
                ("n_eligible", "bigint"), ("n_late", "bigint"),
            )
        ]
    )


def region_sales(totals: DataFrame, *keys: str) -> DataFrame:
    """Orders, revenue, mean ticket (items + freight) and mean review per region key."""
    return (
        totals.groupBy(*keys)
        .agg(
            F.expr("cast(sum(n_orders) as bigint)").alias("total_orders"),
            F.expr("coalesce(sum(revenue), 0.00BD)").alias("total_revenue"),
            mean_of_sums("ticket_sum", "ticket_n", 2).alias("avg_ticket"),
            mean_of_sums("review_sum", "review_n", 2).alias("avg_review_score"),
        )
        .where("total_orders > 0")
    )


def mart_geography_sales(totals: DataFrame) -> DataFrame:
    return region_sales(totals, "customer_state", "customer_city")
