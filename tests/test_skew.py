"""A key holding a third of all rows: it goes around the shuffle, results stay exact."""

from __future__ import annotations

import statistics
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fixture import ITEMS, ORDERS, _item, _order, raw_tables, ts
from tradelens.operators.hot_keys import hot_keys, lookup_join
from tradelens.plans.models import build_models
from tradelens.plans.reconcile import reconcile_detail

HOT = 300


@pytest.fixture
def skew_conf(spark):
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_product_totals_are_exact_on_views_and_published_tables(spark, skew_conf, tmp_dir):
    orders = ORDERS + [_order(f"h{i}", "c1", "delivered", ts(9), ts(10)) for i in range(HOT)]
    items = ITEMS + [_item(f"h{i}", 1, "p2", "s2", 1, 0.1) for i in range(HOT)]
    lazy = build_models(raw_tables(spark, orders=orders, items=items))
    published = {}
    for name in ("dim_products", "fact_orders", "fact_order_items"):
        lazy[name].write.parquet(f"{tmp_dir}/{name}")
        published[name] = spark.read.parquet(f"{tmp_dir}/{name}")
    m = build_models(raw_tables(spark, orders=orders, items=items), overrides=published)
    mart = m["mart_category_performance"]
    rows = {r["product_category"]: r for r in mart.collect()}
    assert rows["artesanal"]["total_orders"] == 2 + HOT
    assert rows["artesanal"]["total_revenue"] == D("45.00") + HOT
    assert rows["books"]["total_revenue"] == D("180.00")
    assert rows == {r["product_category"]: r for r in lazy["mart_category_performance"].collect()}


@pytest.fixture
def skewed(spark):
    """Items of 600 products: one holds a third of the rows, a sixth have none, some have no dimension row."""
    product = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.concat(F.lit("p"), (F.col("id") * 7919) % 600))
    items = spark.range(0, 60_000, numPartitions=8).select(F.col("id").alias("item"), product.alias("product_id"))
    dim = spark.range(500).select(F.concat(F.lit("p"), "id").alias("product_id"), (F.col("id") % 9).alias("category"))
    return items, dim.unionByName(spark.createDataFrame([("hot", 77)], "product_id string, category long"))


def test_hot_keys_are_found_and_bounded(spark, skewed):
    items, _ = skewed
    assert [r[0] for r in hot_keys(items, "product_id", 1 / 32).collect()] == ["hot"]
    assert hot_keys(items.limit(0), "product_id", 1 / 32).count() == 0
    assert hot_keys(items, "product_id", 1 / 1000).count() <= 1000


@pytest.mark.parametrize("share", [None, 1.0, 1 / 5000])
def test_lookup_join_equals_the_plain_join(spark, skewed, share):
    items, dim = skewed
    got = lookup_join(items, dim, "product_id", ["category"], share).select("item", "product_id", "category")
    want = items.join(dim, "product_id", "left").select("item", "product_id", "category")
    assert got.count() == 60_000
    assert got.exceptAll(want).count() == 0


def test_no_task_has_more_than_twice_the_median_rows(spark, skewed, skew_conf):
    items, dim = skewed

    def per_task(joined):
        counts = joined.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        return [r["count"] for r in counts]

    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # nothing is split afterwards
    try:
        plain = per_task(items.join(dim, "product_id", "left"))
        ours = per_task(lookup_join(items, dim, "product_id", ["category"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert max(plain) > 2 * statistics.median(plain)
    assert sum(ours) == 60_000 and max(ours) <= 2 * statistics.median(ours)


def test_category_mart_moves_item_rows_twice(spark):
    """On lazy views: one exchange by product (the rest of the items) and one by order."""
    lazy = build_models(raw_tables(spark))
    plan = lazy["mart_category_performance"]._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("hashpartitioning(order_id" in x and "REPARTITION_BY_COL" in x for x in exchanges) == 1
    assert not any("product_category" in x and "order_id" in x for x in exchanges)


def test_a_repeated_order_row_counts_as_in_the_source_view(spark):
    """Without the gate: both marts see the order twice, once per row."""
    raw = raw_tables(spark, orders=[*ORDERS, ORDERS[0]])
    m = build_models(raw)
    once = build_models(raw_tables(spark))
    for mart, key in (("mart_seller_performance", "seller_id"), ("mart_category_performance", "product_category")):
        twice = {r[key]: r["total_orders"] for r in m[mart].collect()}
        single = {r[key]: r["total_orders"] for r in once[mart].collect()}
        assert sum(twice.values()) > sum(single.values())


def test_reconciliation_moves_item_rows_once(spark, tmp_dir):
    """A seller with a third of the items is one summed row when it meets the sellers."""
    orders = ORDERS + [_order(f"h{i}", "c1", "delivered", ts(9), ts(10)) for i in range(HOT)]
    items = ITEMS + [_item(f"h{i}", 1, "p2", "s2", 1, 0.1) for i in range(HOT)]
    raw = raw_tables(spark, orders=orders, items=items)
    lazy = build_models(raw)
    published = {}
    for name in ("order_items", "orders"):
        raw[name].write.parquet(f"{tmp_dir}/raw_{name}")
    for name in ("mart_seller_performance", "mart_category_performance", "mart_geography_sales", "dim_sellers", "dim_customers"):
        lazy[name].write.parquet(f"{tmp_dir}/{name}")
        published[name] = spark.read.parquet(f"{tmp_dir}/{name}")
    tables = {n: spark.read.parquet(f"{tmp_dir}/raw_{n}") for n in ("order_items", "orders")}
    detail = reconcile_detail(tables, published)
    plan = detail._jdf.queryExecution().executedPlan().toString()
    assert plan.count("price:decimal") == 1  # the items are read once
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("hashpartitioning(order_id" in x for x in moved) == 2  # items and orders, to meet
    assert not any("hashpartitioning(seller_id" in x or "hashpartitioning(customer_id" in x for x in moved)
    rows = {r["mart"]: (r["actual"], r["expected"]) for r in detail.collect()}
    assert set(rows) == {"seller", "category", "geography"} and all(a == e for a, e in rows.values())
