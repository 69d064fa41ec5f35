"""The golden nine-table fixture: every dirty case the marts must handle."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tradelens.contracts import CONTRACTS


def ts(day: int) -> dt.datetime:
    return dt.datetime(2020, 1, day)


def frame(spark, table: str, rows: list[dict]):
    """Rows as dicts (unlisted columns NULL) in the contract's schema."""
    c = CONTRACTS[table]
    data = [tuple(r.get(n) for n in c.expected_columns) for r in rows]
    return spark.createDataFrame(data, c.schema)


D = Decimal

CUSTOMERS = [
    {"customer_id": "c1", "customer_city": "sao paulo", "customer_state": "SP"},
    {"customer_id": "c2", "customer_city": "rio", "customer_state": "RJ"},
    {"customer_id": "c1", "customer_city": "zzz", "customer_state": "SP"},
]
SELLERS = [
    {"seller_id": "s1", "seller_city": "sao paulo", "seller_state": "SP"},
    {"seller_id": "s2", "seller_city": "rio", "seller_state": "RJ"},
    {"seller_id": "s3", "seller_city": "santos", "seller_state": "SP"},
    {"seller_id": "s1", "seller_city": "zzz", "seller_state": "SP"},
]
PRODUCTS = [
    {"product_id": "p1", "product_category_name": "livros"},
    {"product_id": "p2", "product_category_name": " artesanal "},
    {"product_id": "p3", "product_category_name": ""},
    {"product_id": "p1", "product_category_name": "zzz"},
]
TRANSLATION = [
    {"product_category_name": "livros", "product_category_name_english": "books"},
    {"product_category_name": "livros", "product_category_name_english": "zzz"},
]
PAYMENTS = [
    {"order_id": "o1", "payment_sequential": 1, "payment_value": D("100")},
    {"order_id": "o1", "payment_sequential": 2, "payment_value": D("92.5")},
]


def _order(oid, cust, status, delivered, estimated):
    return {
        "order_id": oid,
        "customer_id": cust,
        "order_status": status,
        "order_delivered_customer_date": delivered,
        "order_estimated_delivery_date": estimated,
    }


ORDERS = [
    _order("o1", "c1", "delivered", ts(12), ts(10)),
    _order("o2", "c1", "delivered", ts(8), ts(10)),
    _order("o3", "c1", "delivered", None, ts(10)),
    _order("o4", "c1", "canceled", ts(12), ts(10)),
    _order("o5", "c1", "shipped", ts(12), ts(10)),
    _order("o6", "c1", "delivered", ts(10), ts(10)),
    _order("o7", "c1", "delivered", ts(12), None),
    _order("o8", "missing", "delivered", ts(12), ts(10)),
    _order("o9", "c2", "delivered", None, ts(10)),
]


def _item(oid, n, product, seller, price, freight):
    return {
        "order_id": oid,
        "order_item_id": n,
        "product_id": product,
        "seller_id": seller,
        "price": D(str(price)),
        "freight_value": D(str(freight)),
    }


ITEMS = [
    _item("o1", 1, "p1", "s1", 100, 10),
    _item("o1", 2, "p1", "s1", 50, 5),
    _item("o1", 3, "p2", "s2", 25, 2.5),
    _item("o2", 1, "p1", "s1", 30, 3),
    _item("o3", 1, "p3", "s1", 40, 4),
    _item("o4", 1, "p1", "s1", 999, 99),
    _item("o5", 1, "p1", "s1", 888, 88),
    _item("o6", 1, "p2", "s2", 20, 2),
    _item("o7", 1, "missing", "s1", 15, 1.5),
    _item("o8", 1, "missing", "missing", 80, 8),
    _item("o9", 1, "p3", "s3", 10, 1),
]


def _review(rid, oid, score):
    return {"review_id": rid, "order_id": oid, "review_score": score}


REVIEWS = [
    _review("r1", "o1", 1),
    _review("r2", "o1", 5),
    _review("r3", "o2", 5),
    _review("r1", "o6", 4),
    _review("r5", "o7", 2),
    _review("r6", "o8", 1),
    _review("r7", "o9", None),
]


def raw_tables(spark, *, orders=ORDERS, items=ITEMS, reviews=REVIEWS, customers=CUSTOMERS):
    return {
        "orders": frame(spark, "orders", orders),
        "order_items": frame(spark, "order_items", items),
        "order_payments": frame(spark, "order_payments", PAYMENTS),
        "order_reviews": frame(spark, "order_reviews", reviews),
        "customers": frame(spark, "customers", customers),
        "products": frame(spark, "products", PRODUCTS),
        "sellers": frame(spark, "sellers", SELLERS),
        "category_translation": frame(spark, "category_translation", TRANSLATION),
        "geolocation": frame(spark, "geolocation", []),
    }
