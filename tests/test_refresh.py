"""Refresh end to end from CSV landing files; the gate stops bad data early."""

from __future__ import annotations

import json
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fixture import raw_tables
from tradelens.contracts import CONTRACTS
from tradelens.operators.quality import DataQualityError
from tradelens.plans.lineage import lineage_edges
from tradelens.plans.refresh import run_refresh
from tradelens.operators.checks import TableTestError
from tradelens.plans import analyses, marts, models, profiles, serving
from tradelens.plans.refresh import ReconciliationError
from tradelens.sinks import releases
from tradelens.sinks.reload import read_table
from tradelens.sources.landing import write_csv


def land(raw, root, overrides=None):
    for name, df in {**raw, **(overrides or {})}.items():
        write_csv(df.coalesce(1), f"{root}/{CONTRACTS[name].csv_filename}")


def test_refresh_builds_and_tests_every_layer(spark, tmp_dir):
    raw = raw_tables(spark)
    land(raw, f"{tmp_dir}/landing")
    result = run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh")
    assert result.raw_rows["raw.orders"] == 9
    assert result.model_rows["analytics.mart_seller_performance"] == 3
    assert len(result.tests) == 45
    mart = read_table(spark, f"{tmp_dir}/wh", "analytics.mart_category_performance")
    assert mart.agg(F.sum("total_revenue")).collect()[0][0] == D("370.00")
    # Running the refresh again gives the same tables.
    again = run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh")
    assert again.table_rows() == result.table_rows()
    # A part of the datasets is reloaded beside the raw tables already published.
    part = run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh", datasets=["sellers"])
    assert list(part.raw_rows) == ["raw.sellers"]
    assert part.model_rows == result.model_rows


def test_failing_gold_test_and_reconciliation_leave_the_old_release(spark, tmp_dir, monkeypatch):
    raw = raw_tables(spark)
    land(raw, f"{tmp_dir}/landing")
    run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh")
    before = releases.live_manifest(spark, f"{tmp_dir}/wh")
    assert len(before) == 24  # 23 tables and the region sums
    items = raw["order_items"]
    land({"order_items": items.unionByName(items.limit(1))}, f"{tmp_dir}/more")
    for name in CONTRACTS:
        if name != "order_items":
            os.symlink(f"{tmp_dir}/landing/{CONTRACTS[name].csv_filename}", f"{tmp_dir}/more/{CONTRACTS[name].csv_filename}")
    with pytest.raises(TableTestError, match="unique_columns_order_items"):  # a silver test
        run_refresh(spark, f"{tmp_dir}/more", f"{tmp_dir}/wh")
    real = marts.mart_seller_performance
    broken = {"total_revenue": -F.col("total_revenue")}, {"total_revenue": F.col("total_revenue") + 1}
    for changed, error in zip(broken, (TableTestError, ReconciliationError), strict=True):  # gold test, then totals
        monkeypatch.setitem(models._BUILDERS, "mart_seller_performance", lambda *x, c=changed: real(*x).withColumns(c))
        with pytest.raises(error):
            run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh")
    assert releases.live_manifest(spark, f"{tmp_dir}/wh") == before
    folders = [f for t in before for f in os.listdir(releases.table_folder(f"{tmp_dir}/wh", t))]
    assert len(folders) == 24  # what was staged is gone


def test_published_answers_need_no_order_rows_and_no_scan(spark, tmp_dir):
    land(raw_tables(spark), f"{tmp_dir}/landing")
    run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh", catalog=True)
    published = models.published_models(spark, f"{tmp_dir}/wh")
    lazy = models.build_models(raw_tables(spark))
    for answer in (serving.states, analyses.state_revenue, lambda m: analyses.late_rate_by_state(m, min_eligible=1)):
        plan = answer(published)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "n_" in plan and "order_id" not in plan
        assert answer(published).collect() == answer(lazy).collect()
    for answer in (serving.readiness, profiles.view_counts):
        assert "FileScan" not in answer(published)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, answer(published).collect())) == sorted(map(tuple, answer(lazy).collect()))
    # Another session names the tables as the source system does.
    other = spark.newSession()
    got = other.sql("SELECT customer_state, total_orders, total_revenue FROM analytics.mart_geography_sales").collect()
    want = lazy["mart_geography_sales"].select("customer_state", "total_orders", "total_revenue").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) >= 2
    assert other.sql("SELECT count(*) FROM silver.orders").first()[0] == published["orders"].count()
    # The views follow the live release.
    land({"sellers": raw_tables(spark)["sellers"].where("seller_id = 's1'")}, f"{tmp_dir}/few")
    run_refresh(spark, f"{tmp_dir}/few", f"{tmp_dir}/wh", datasets=["sellers"], catalog=True)
    assert other.sql("SELECT count(*) FROM analytics.dim_sellers").first()[0] == 1
    assert published["dim_sellers"].count() == 3  # a reader stays on its release
    for schema in ("analytics", "silver", "raw"):
        spark.sql(f"DROP SCHEMA {schema} CASCADE")


def test_rejected_values_go_to_quarantine(spark, tmp_dir):
    raw = raw_tables(spark)
    n = raw["order_items"].where("seller_id = 's1'").count()
    text = {name: raw[name].select(*[F.col(c).cast("string").alias(c) for c in raw[name].columns]) for name in ("order_items", "order_reviews")}
    items = text["order_items"].withColumn("price", F.when(F.col("seller_id") == "s1", "n/a").otherwise(F.col("price")))
    reviews = text["order_reviews"].withColumn("review_creation_date", F.lit("a\nb"))
    land(raw, f"{tmp_dir}/landing", {"order_items": items, "order_reviews": reviews})
    with pytest.raises(DataQualityError, match="does not fit price.*rejected value"):
        run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh")
    assert releases.live_manifest(spark, f"{tmp_dir}/wh").number == 0
    run = os.listdir(f"{tmp_dir}/wh/_quarantine")
    rows = spark.read.parquet(f"{tmp_dir}/wh/_quarantine/{run[0]}").collect()
    assert {(r["table"], r["column"]) for r in rows} == {("raw.order_items", "price"), ("raw.order_reviews", "review_creation_date")}
    prices = [r for r in rows if r["column"] == "price"]
    assert len(prices) == n and {(r["value"], r["reason"]) for r in prices} == {("n/a", "not a decimal(8,2)")}
    assert all(CONTRACTS["order_items"].csv_filename in r["file"] and json.loads(r["record"])["seller_id"] == "s1" for r in prices)
    dates = [r for r in rows if r["column"] == "review_creation_date"]
    assert len(dates) == reviews.count() and all(r["value"] == "a\nb" and r["file"] for r in dates)


def test_validation_error_loads_nothing(spark, tmp_dir):
    raw = raw_tables(spark)
    bad_items = raw["order_items"].withColumn("price", -F.col("price"))
    land(raw, f"{tmp_dir}/landing", {"order_items": bad_items})
    with pytest.raises(DataQualityError, match="negative price"):
        run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh")
    assert not os.path.exists(f"{tmp_dir}/wh")


def test_part_of_the_datasets_needs_the_others_published(spark, tmp_dir):
    land(raw_tables(spark), f"{tmp_dir}/landing")
    with pytest.raises(FileNotFoundError, match="no published version"):
        run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh", datasets=["sellers"])
    assert not os.path.exists(f"{tmp_dir}/wh")


def test_missing_source_file_fails_before_reading(spark, tmp_dir):
    raw = raw_tables(spark)
    land({"orders": raw["orders"]}, f"{tmp_dir}/landing")
    with pytest.raises(FileNotFoundError, match="olist_customers_dataset.csv"):
        run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh")


def test_lineage_edges():
    edges = set(lineage_edges())
    assert ("analytics.fact_orders", "analytics", "silver.order_review_summary") in edges
    assert ("silver.orders", "silver", "raw.orders") in edges
    assert len({e[0] for e in edges}) == 14
