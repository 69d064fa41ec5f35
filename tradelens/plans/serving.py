"""Served metric queries: ranked, keyed and regional lookups over the models.

Parameters are checked on the driver before any job, keyed lookups bind their
value as a parameter (never spliced into SQL text), and every top-k carries a
unique tie-break so that the cut is deterministic (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.plans.marts import region_sales
from tradelens.plans.models import PublishedModels

MAX_LIMIT = 100
SELLER_ID_MAX = 32

# Sources the served queries read; the readiness probe resolves each of them.
SERVING_SOURCES = (
    "mart_seller_performance",
    "mart_category_performance",
    "dim_customers",
    "fact_orders",
    "order_item_summary",
)


class NotFoundError(LookupError):
    """A keyed lookup found no row."""


def check_limit(limit: object) -> int:
    """Limit must be an integer in [1, 100]; strings and floats are rejected."""
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise ValueError(f"limit must be an integer in [1, {MAX_LIMIT}], got {limit!r}")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be an integer in [1, {MAX_LIMIT}], got {limit!r}")
    return limit


def check_seller_id(seller_id: object) -> str:
    if not isinstance(seller_id, str) or not 1 <= len(seller_id) <= SELLER_ID_MAX:
        raise ValueError(f"seller_id must be a string of 1 to {SELLER_ID_MAX} characters")
    return seller_id


def top_sellers(models: Mapping[str, DataFrame], limit: int = 10) -> DataFrame:
    n = check_limit(limit)
    return (
        models["mart_seller_performance"]
        .orderBy(F.col("total_revenue").desc_nulls_last(), F.col("seller_id").asc_nulls_last())
        .limit(n)
    )


def seller_by_id(models: Mapping[str, DataFrame], seller_id: str) -> DataFrame:
    """Rows of one seller; the id is compared as a value, so SQL text in it is inert."""
    sid = check_seller_id(seller_id)
    return models["mart_seller_performance"].where(F.col("seller_id") == F.lit(sid))


def seller_performance(models: Mapping[str, DataFrame], seller_id: str) -> dict:
    """One seller's metrics as a dict; raises ``NotFoundError`` when absent."""
    rows = seller_by_id(models, seller_id).limit(1).collect()
    if not rows:
        raise NotFoundError("No delivered sales found for seller")
    return rows[0].asDict()


def categories(models: Mapping[str, DataFrame], limit: int = 100) -> DataFrame:
    n = check_limit(limit)
    return (
        models["mart_category_performance"]
        .orderBy(
            F.col("total_revenue").desc_nulls_last(), F.col("product_category").asc_nulls_last()
        )
        .limit(n)
    )


def states(models: Mapping[str, DataFrame], limit: int = 100) -> DataFrame:
    """Per customer state, from the exact sums per region (not from the rounded city mart)."""
    n = check_limit(limit)
    return (
        region_sales(models["region_totals"], "customer_state")
        .orderBy(
            F.col("total_revenue").desc_nulls_last(), F.col("customer_state").asc_nulls_last()
        )
        .limit(n)
    )


def readiness(models: Mapping[str, DataFrame]) -> DataFrame:
    """One row per serving source: its column count and whether a row can be read.

    Resolving each plan (``schema``) fails on a missing or broken source before
    any job; the probe then reads at most one row of each (``limit(1)``), so an
    empty source passes with ``sample_rows = 0``.  Published sources are answered
    from their release's manifest, without reading data.
    """
    if isinstance(models, PublishedModels):
        rows = [
            (name, len(models[name].columns), min(1, models.rows(name) or 0)) for name in SERVING_SOURCES
        ]
        spark = models[SERVING_SOURCES[0]].sparkSession
        return spark.createDataFrame(rows, "source string, n_columns int, sample_rows long")
    probes = []
    for name in SERVING_SOURCES:
        df = models[name]
        n_columns = len(df.schema.fields)  # analysis only, no job
        probes.append(
            df.limit(1)
            .agg(F.count(F.lit(1)).alias("sample_rows"))
            .select(
                F.lit(name).alias("source"),
                F.lit(n_columns).alias("n_columns"),
                "sample_rows",
            )
        )
    out = probes[0]
    for p in probes[1:]:
        out = out.unionByName(p)
    return out
