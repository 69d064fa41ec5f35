"""End-to-end golden case: exact mart rows from a nine-table fixture."""

from __future__ import annotations

from decimal import Decimal as D

import pytest

from fixture import ITEMS, REVIEWS, CUSTOMERS, ORDERS, _item, _order, _review, raw_tables, ts
from tradelens.operators import checks
from tradelens.plans import reconcile, serving
from tradelens.plans.models import build_models


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def models(spark):
    return build_models(raw_tables(spark))


def test_seller_mart(models):
    got = rows(
        models["mart_seller_performance"],
        "seller_id", "total_orders", "total_items_sold", "total_revenue", "avg_order_value",
        "avg_freight_value", "avg_review_score", "avg_delivery_delay_days", "late_delivery_rate",
    )
    assert got == [
        ("s1", 4, 5, D("235.00"), D("58.75"), D("5.88"), D("3.33"), D("0.00"), D("0.5000")),
        ("s2", 2, 2, D("45.00"), D("22.50"), D("2.25"), D("3.50"), D("1.00"), D("0.5000")),
        ("s3", 1, 1, D("10.00"), D("10.00"), D("1.00"), None, None, None),
    ]
    cities = rows(models["mart_seller_performance"], "seller_id", "seller_city")
    assert cities == [("s1", "sao paulo"), ("s2", "rio"), ("s3", "santos")]


def test_category_mart(models):
    got = rows(
        models["mart_category_performance"],
        "product_category", "total_orders", "total_items_sold", "total_revenue", "avg_price",
        "avg_review_score", "late_delivery_rate",
    )
    assert got == [
        ("artesanal", 2, 2, D("45.00"), D("22.50"), D("3.50"), D("0.5000")),
        ("books", 2, 3, D("180.00"), D("60.00"), D("4.00"), D("0.5000")),
        ("unknown", 4, 4, D("145.00"), D("36.25"), D("1.50"), D("1.0000")),
    ]


def test_geography_mart(models):
    got = rows(
        models["mart_geography_sales"],
        "customer_state", "customer_city", "total_orders", "total_revenue", "avg_ticket",
        "avg_review_score",
    )
    assert got == [
        ("RJ", "rio", 1, D("10.00"), D("11.00"), None),
        ("SP", "sao paulo", 5, D("280.00"), D("61.60"), D("3.50")),
    ]


def test_fact_items_repeat_order_payment(models):
    o1 = models["fact_order_items"].where("order_id = 'o1'").collect()
    assert len(o1) == 3
    assert {r["order_total_payment_value"] for r in o1} == {D("192.50")}


def test_fact_order_flags(models):
    got = {
        r["order_id"]: (r["is_delivered"], r["is_late_delivery"], r["has_delivery_outcome"])
        for r in models["fact_orders"].collect()
    }
    assert got["o1"] == (True, True, True)
    assert got["o2"] == (True, False, True)
    assert got["o3"] == (True, False, False)
    assert got["o6"] == (True, False, True)  # equal to the estimate is not late
    assert got["o4"] == (False, True, False)


def test_served_rankings(models):
    top = [r["seller_id"] for r in serving.top_sellers(models, 2).collect()]
    assert top == ["s1", "s2"]
    cats = [r["product_category"] for r in serving.categories(models).collect()]
    assert cats == ["books", "unknown", "artesanal"]


def test_extra_review_does_not_change_sales(spark):
    m = build_models(raw_tables(spark, reviews=REVIEWS + [_review("r8", "o1", 3)]))
    totals = m["mart_category_performance"].agg(
        {"total_revenue": "sum", "total_items_sold": "sum"}
    ).collect()[0]
    assert totals["sum(total_revenue)"] == D("370.00")
    assert totals["sum(total_items_sold)"] == 9


def test_state_extension(spark):
    customers = CUSTOMERS + [
        {"customer_id": "c3", "customer_city": "campinas", "customer_state": "SP"},
        {"customer_id": "c4"},
    ]
    orders = ORDERS + [
        _order("o10", "c3", "delivered", None, None),
        _order("o11", "c3", "delivered", None, None),
        _order("o12", "c4", "delivered", None, None),
    ]
    items = ITEMS + [
        _item("o10", 1, "p1", "s1", 10, 1),
        _item("o11", 1, "p1", "s1", 20, 2),
        _item("o12", 1, "p1", "s1", 30, 3),
    ]
    reviews = REVIEWS + [_review("r8", "o1", 3), _review("r10", "o10", 1),
                         _review("r12", "o12", 5)]
    m = build_models(
        raw_tables(spark, orders=orders, items=items, reviews=reviews, customers=customers)
    )
    got = [
        (r["customer_state"], r["total_orders"], r["total_revenue"], r["avg_ticket"],
         r["avg_review_score"])
        for r in serving.states(m).collect()
    ]
    assert got == [
        ("SP", 7, D("310.00"), D("48.71"), D("3.00")),
        (None, 1, D("30.00"), D("33.00"), D("5.00")),
        ("RJ", 1, D("10.00"), D("11.00"), None),
    ]


def test_suite_passes_and_revenue_reconciles(spark, models):
    raw = raw_tables(spark)
    summary = checks.assert_suite(checks.run_suite(models, checks.ALL_TESTS))
    assert len(summary) == 44
    detail = {r["mart"]: (r["actual"], r["expected"])
              for r in reconcile.reconcile_detail(raw, models).collect()}
    assert detail["category"] == (D("370.00"), D("370.00"))
    assert reconcile.reconcile_revenue(raw, models).count() == 0


def test_duplicate_item_fails_unique_columns(spark):
    m = build_models(raw_tables(spark, items=ITEMS + [ITEMS[0]]))
    with pytest.raises(checks.TableTestError, match="unique_columns_order_items"):
        checks.assert_suite(checks.run_suite(m, checks.SILVER_TESTS))


def test_rebuild_is_repeatable(spark, models):
    again = build_models(raw_tables(spark))
    for name in ("mart_seller_performance", "mart_category_performance", "mart_geography_sales"):
        assert sorted(map(tuple, again[name].collect())) == sorted(map(tuple, models[name].collect()))


def test_analyses_on_the_fixture(models):
    from tradelens.plans import analyses

    # eligible o1, o2, o6, o8; late o1, o8
    f1 = analyses.late_rate(models).collect()[0]
    assert (f1["eligible_orders"], f1["late_orders"], f1["late_pct"]) == (4, 2, D("50.00"))
    # E4: late (o1 3.0, o8 1) vs on time (o2 5, o6 4)
    e4 = {r["is_late_delivery"]: (r["orders"], r["avg_review_score"])
          for r in analyses.review_by_lateness(models).collect()}
    assert e4 == {True: (2, D("2.00")), False: (2, D("4.50"))}
    # E5: delivered items 370.00 price, 37.00 freight
    e5 = analyses.freight_share(models).collect()[0]
    assert (e5["item_revenue"], e5["freight"], e5["freight_pct_of_items"]) == (
        D("370.00"), D("37.00"), D("10.00"))
    # three sellers, all in the top 10
    f2 = analyses.top10_share(models).collect()[0]
    assert (f2["top10_revenue"], f2["top10_pct"]) == (D("290.00"), D("100.00"))
    # SP has o1, o2, o6 eligible and o1 late; RJ has none eligible
    f3 = [(r["customer_state"], r["eligible"], r["late_rate"])
          for r in analyses.late_rate_by_state(models, min_eligible=1).collect()]
    assert f3 == [("SP", 3, D("0.3333"))]
    # E3: delivered orders and item revenue per state
    e3 = [(r["customer_state"], r["delivered_orders"], r["item_revenue"])
          for r in analyses.state_revenue(models).collect()]
    assert e3 == [("SP", 5, D("280.00")), ("RJ", 1, D("10.00"))]
