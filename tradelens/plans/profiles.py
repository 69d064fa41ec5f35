"""Profiles of raw tables and published views (samples, counts, extremes)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.plans.models import PublishedModels

PUBLISHED_VIEWS = (
    "fact_orders",
    "fact_order_items",
    "mart_seller_performance",
    "mart_category_performance",
    "mart_geography_sales",
)


def delivered_sample(raw_orders: DataFrame, n: int = 10) -> DataFrame:
    """``n`` delivered raw orders; ordered by id so the sample is reproducible."""
    return raw_orders.where(F.col("order_status") == "delivered").orderBy("order_id").limit(n)


def _stack_counts(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias(label), "n_rows")
        for name, df in frames.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_counts(raw: Mapping[str, DataFrame], n: int = 5) -> DataFrame:
    """Rows read by an ``n``-row sample of every raw table (all must reach ``n``)."""
    return _stack_counts({k: v.limit(n) for k, v in raw.items()}, "table_name")


def view_counts(models: Mapping[str, DataFrame],
                views: Sequence[str] = PUBLISHED_VIEWS) -> DataFrame:
    """Row count of each published fact and mart (from the manifest where a release holds them)."""
    if isinstance(models, PublishedModels):
        spark = models[views[0]].sparkSession
        return spark.createDataFrame([(v, models.rows(v)) for v in views], "view_name string, n_rows long")
    return _stack_counts({v: models[v] for v in views}, "view_name")


def heaviest_product(raw_products: DataFrame) -> DataFrame:
    """Category of the heaviest product (ties: largest product id) and the top weight."""
    weighed = raw_products.where(F.col("product_weight_g").isNotNull())
    return weighed.agg(
        F.max_by("product_category_name", F.struct("product_weight_g", "product_id")).alias(
            "heaviest_category"
        ),
        F.max("product_weight_g").alias("max_weight_g"),
    )
