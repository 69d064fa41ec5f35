"""Binding: derive the nine raw marketplace tables from the shared test tables.

The driver's test data is a TPC-H-shaped star schema plus an ``events`` table.
Each raw table is derived from it by integer arithmetic that DuckDB can express
identically (see ``oracle_duckdb.py``), so every model can be checked against
an independent SQL engine on the same input.  The derivation deliberately
plants the dirty cases the models must handle: padded and blank ids, duplicate
dimension rows that must lose, untranslated and blank categories, missing
products and sellers, NULL prices, scores and delivery dates, repeated review
ids and multi-payment orders.

All derivations are narrow projections of one scan (plus a per-order
``row_number`` for item and payment sequence numbers), so they scale with the
input and push column pruning into the Parquet reads.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.contracts import CONTRACTS

SOURCE_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "nation")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _txt(c: str) -> Column:
    return F.col(c).cast("string")


def _padded(c: str) -> Column:
    return F.concat(F.lit(" "), _txt(c), F.lit(" "))


def _state(c: str) -> Column:
    return F.lpad(_txt(c), 2, "0")


def _hours_after(ts: str, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, F.col(ts))


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the contract's column order and types."""
    c = CONTRACTS[table]
    return df.select(*[F.col(n).cast(r.dtype).alias(n) for n, r in c.columns])


def customers(customer: DataFrame) -> DataFrame:
    base = customer.select(
        _txt("c_custkey").alias("customer_id"),
        F.concat(F.lit("u"), _txt("c_custkey")).alias("customer_unique_id"),
        (F.col("c_nationkey") * 1000 + (F.col("c_custkey") % 1000)).alias(
            "customer_zip_code_prefix"
        ),
        F.col("c_mktsegment").alias("customer_city"),
        F.when(F.col("c_nationkey") == 24, F.lit(None)).otherwise(_state("c_nationkey")).alias(
            "customer_state"
        ),
    )
    dup = customer.where(F.col("c_custkey") % 10 == 0).select(
        _padded("c_custkey").alias("customer_id"),
        F.concat(F.lit("u"), _txt("c_custkey")).alias("customer_unique_id"),
        (F.col("c_nationkey") * 1000 + (F.col("c_custkey") % 1000)).alias(
            "customer_zip_code_prefix"
        ),
        F.lit("zzz").alias("customer_city"),
        F.lit("99").alias("customer_state"),
    )
    return _conform(base.unionByName(dup), "customers")


def sellers(supplier: DataFrame) -> DataFrame:
    zip_code = F.col("s_nationkey") * 1000 + (F.col("s_suppkey") % 1000)
    base = supplier.where(F.col("s_suppkey") % 50 != 49).select(
        _txt("s_suppkey").alias("seller_id"),
        zip_code.alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        _state("s_nationkey").alias("seller_state"),
    )
    dup = supplier.where(F.col("s_suppkey") % 10 == 0).select(
        _padded("s_suppkey").alias("seller_id"),
        zip_code.alias("seller_zip_code_prefix"),
        F.lit("zzz").alias("seller_city"),
        F.lit("99").alias("seller_state"),
    )
    return _conform(base.unionByName(dup), "sellers")


def _product_attrs() -> list[Column]:
    s = F.col("p_size")
    return [
        s.alias("product_name_lenght"),
        (s * 10).alias("product_description_lenght"),
        (s % 5).alias("product_photos_qty"),
        (s * 100).alias("product_weight_g"),
        s.alias("product_length_cm"),
        (s + 1).alias("product_height_cm"),
        (s + 2).alias("product_width_cm"),
    ]


def products(part: DataFrame) -> DataFrame:
    label = (
        F.when(F.col("p_partkey") % 17 == 0, F.lit(""))
        .otherwise(F.concat(F.lit(" "), F.lower("p_type")))
    )
    base = part.where(F.col("p_partkey") % 97 != 96).select(
        _txt("p_partkey").alias("product_id"),
        label.alias("product_category_name"),
        *_product_attrs(),
    )
    dup = part.where((F.col("p_partkey") % 13 == 0) & (F.col("p_partkey") % 97 != 96)).select(
        _padded("p_partkey").alias("product_id"),
        F.lit("zzz").alias("product_category_name"),
        *_product_attrs(),
    )
    return _conform(base.unionByName(dup), "products")


def category_translation(part: DataFrame) -> DataFrame:
    labels = part.where(F.col("p_type") != "PROMO").select(
        F.lower("p_type").alias("product_category_name")
    ).distinct()
    english = labels.select(
        "product_category_name",
        F.concat(F.lit("en_"), F.col("product_category_name")).alias(
            "product_category_name_english"
        ),
    )
    loser = labels.select(
        "product_category_name", F.lit("zzz").alias("product_category_name_english")
    )
    return _conform(english.unionByName(loser), "category_translation")


def orders(orders_src: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    delivered_hours = ((k * 7919) % 41) * 24 + (k % 24)
    return _conform(
        orders_src.select(
            F.when(k % 89 == 0, _padded("o_orderkey")).otherwise(_txt("o_orderkey")).alias(
                "order_id"
            ),
            _txt("o_custkey").alias("customer_id"),
            F.when(F.col("o_orderstatus") == "F", "delivered")
            .when(F.col("o_orderstatus") == "O", "shipped")
            .when(F.col("o_orderstatus") == "P", "processing")
            .alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            _hours_after("o_orderdate", k % 48).alias("order_approved_at"),
            _hours_after("o_orderdate", 48 + k % 24).alias("order_delivered_carrier_date"),
            F.when(k % 37 == 0, F.lit(None))
            .otherwise(_hours_after("o_orderdate", delivered_hours))
            .alias("order_delivered_customer_date"),
            F.when(k % 53 == 0, F.lit(None))
            .otherwise(_hours_after("o_orderdate", F.lit(480)))
            .alias("order_estimated_delivery_date"),
        ),
        "orders",
    )


def order_items(lineitem: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    price = F.col("l_extendedprice").cast("decimal(8,2)")
    return _conform(
        lineitem.select(
            _txt("l_orderkey").alias("order_id"),
            F.row_number().over(w).alias("order_item_id"),
            _txt("l_partkey").alias("product_id"),
            _txt("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.when((F.col("l_orderkey") % 101 == 0) & (F.col("l_linenumber") == 1), F.lit(None))
            .otherwise(price)
            .alias("price"),
            (F.col("l_quantity").cast("bigint") * F.lit(35) * F.lit(0.01).cast("decimal(3,2)"))
            .cast("decimal(8,2)")
            .alias("freight_value"),
        ),
        "order_items",
    )


_REVIEW_TYPES = ("click", "view", "signup")
_PAYMENT_TYPES_SRC = ("purchase", "error")


def order_reviews(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    src = events.where(F.col("event_type").isin(*_REVIEW_TYPES))
    base = src.select(
        _txt("event_id").alias("review_id"),
        (F.expr("event_id div 3") * 2).cast("string").alias("order_id"),
        F.when(e % 11 == 0, F.lit(None)).otherwise(e % 5 + 1).alias("review_score"),
        F.when(e % 7 == 0, F.col("event_type")).alias("review_comment_title"),
        F.when(e % 3 == 0, F.col("props")).alias("review_comment_message"),
        F.col("ts").alias("review_creation_date"),
        F.timestamp_add("HOUR", F.lit(24), F.col("ts")).alias("review_answer_timestamp"),
    )
    # Repeated review ids on another order: kept and averaged, only warned about.
    repeated = src.where(e % 13 == 0).select(
        _txt("event_id").alias("review_id"),
        (F.expr("event_id div 3") * 2 + 1).cast("string").alias("order_id"),
        (e % 5 + 1).alias("review_score"),
        F.when(e % 7 == 0, F.col("event_type")).alias("review_comment_title"),
        F.when(e % 3 == 0, F.col("props")).alias("review_comment_message"),
        F.col("ts").alias("review_creation_date"),
        F.timestamp_add("HOUR", F.lit(24), F.col("ts")).alias("review_answer_timestamp"),
    )
    return _conform(base.unionByName(repeated), "order_reviews")


def order_payments(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    order_key = F.expr("event_id div 2")
    src = events.where(F.col("event_type").isin(*_PAYMENT_TYPES_SRC)).withColumn(
        "_order", order_key
    )
    w = Window.partitionBy("_order").orderBy("event_id")
    ptype = F.element_at(
        F.array(*[F.lit(t) for t in CONTRACTS["order_payments"].rules["payment_type"].allowed]),
        (e % 5 + 1).cast("int"),
    )
    return _conform(
        src.select(
            _txt("_order").alias("order_id"),
            F.row_number().over(w).alias("payment_sequential"),
            ptype.alias("payment_type"),
            (e % 10 + 1).alias("payment_installments"),
            F.col("value").cast("decimal(8,2)").alias("payment_value"),
        ),
        "order_payments",
    )


def geolocation(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    cents = F.lit(0.01).cast("decimal(3,2)")
    return _conform(
        customer.select(
            (F.col("c_nationkey") * 1000 + (k % 1000)).alias("geolocation_zip_code_prefix"),
            (-(k % 3000) * cents).alias("geolocation_lat"),
            (-(k % 7000) * cents).alias("geolocation_lng"),
            F.col("c_mktsegment").alias("geolocation_city"),
            _state("c_nationkey").alias("geolocation_state"),
        ),
        "geolocation",
    )


_DERIVATIONS = {
    "orders": (orders, "orders"),
    "order_items": (order_items, "lineitem"),
    "order_payments": (order_payments, "events"),
    "order_reviews": (order_reviews, "events"),
    "customers": (customers, "customer"),
    "products": (products, "part"),
    "sellers": (sellers, "supplier"),
    "category_translation": (category_translation, "part"),
    "geolocation": (geolocation, "customer"),
}


class RawTables(Mapping[str, DataFrame]):
    """The nine typed raw tables as lazy DataFrames, derived on first access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._dir = sf_dir
        self._sources: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        if name not in self._sources:
            self._sources[name] = _read(self._spark, self._dir, name)
        return self._sources[name]

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._tables:
            derive, src = _DERIVATIONS[table]
            self._tables[table] = derive(self.source(src))
        return self._tables[table]

    def __iter__(self):
        return iter(CONTRACTS)

    def __len__(self) -> int:
        return len(CONTRACTS)

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        try:
            return self[table]
        except KeyError as exc:
            raise AttributeError(table) from exc

    def as_dict(self) -> "RawTables":
        return self


def bind(spark: SparkSession, sf_dir: str) -> RawTables:
    """Raw marketplace tables derived from the test tables under ``sf_dir``."""
    return RawTables(spark, sf_dir)
