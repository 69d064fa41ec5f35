"""Registered queries of the quality, test, source, sink and pipeline operators.

Negative cases are derived from the bound tables inside the query (e.g. prices
negated for every 997th order), so each check has findings to report and its
work still grows with the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.contracts import CONTRACTS
from tradelens.operators import checks, quality
from tradelens.plans import profiles, reconcile, serving
from tradelens.plans.models import Models, build_models
from tradelens.plans.refresh import run_refresh
from tradelens.session import run_concurrently, scratch_path, short_shuffles
from tradelens.sinks import records, reload
from tradelens.sources import typed
from tradelens.sources.binding import bind
from tradelens.sources.landing import Landing, write_csv


def _raw(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    return bind(spark, sf_dir).as_dict()


def _key_mod(column: str, m: int) -> Column:
    return F.trim(F.col(column)).cast("bigint") % m == 0


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


# --- validators -----------------------------------------------------------------
def dq_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _raw(spark, sf_dir)["orders"].drop("order_approved_at", "order_status")
    issues = quality.validate_frame(orders, CONTRACTS["orders"])
    return issues.where(F.col("check") == quality.MISSING_COLUMNS)


def dq_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    parts = [quality.duplicate_keys(df, CONTRACTS[n]) for n, df in raw.items()]
    return _union([p for p in parts if p is not None])


def _negated_items(raw: Mapping[str, DataFrame]) -> DataFrame:
    items = raw["order_items"]
    return items.withColumn(
        "price", F.when(_key_mod("order_id", 997), -F.col("price")).otherwise(F.col("price"))
    ).withColumn(
        "freight_value",
        F.when(_key_mod("order_id", 991), -F.col("freight_value")).otherwise(
            F.col("freight_value")
        ),
    )


def dq_negative_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _negated_items(_raw(spark, sf_dir))
    issues = quality.validate_frame(items, CONTRACTS["order_items"])
    return issues.where(F.col("check") == quality.NEGATIVE_MONETARY)


def dq_out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = _raw(spark, sf_dir)["order_reviews"]
    score = (
        F.when(_key_mod("review_id", 97), F.lit(0))
        .when(_key_mod("review_id", 89), F.lit(6))
        .otherwise(F.col("review_score"))
    )
    issues = quality.validate_frame(
        reviews.withColumn("review_score", score.cast("smallint")), CONTRACTS["order_reviews"]
    )
    return issues.where(F.col("check") == quality.OUT_OF_BOUNDS)


def dq_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _raw(spark, sf_dir)["orders"]
    early = F.timestamp_add("HOUR", F.lit(-1), F.col("order_purchase_timestamp"))
    delivered = F.when(_key_mod("order_id", 71), early).otherwise(
        F.col("order_delivered_customer_date")
    )
    issues = quality.validate_frame(
        orders.withColumn("order_delivered_customer_date", delivered), CONTRACTS["orders"]
    )
    return issues.where(F.col("check") == quality.DATE_ORDERING)


def dq_null_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = quality.validate_all(_raw(spark, sf_dir))
    return issues.where(F.col("check") == quality.NULL_HEAVY)


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_all(_raw(spark, sf_dir))


def dq_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outcome(quality.validate_all(_raw(spark, sf_dir)))


def dq_extract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    orders = raw["orders"].withColumn("debug_column", F.lit("x"))
    sellers = raw["sellers"].where(F.col("seller_id") == "__none__")
    issues = _union(
        [
            quality.validate_frame(orders, CONTRACTS["orders"]),
            quality.validate_frame(sellers, CONTRACTS["sellers"]),
        ]
    )
    return issues.where(
        F.col("check").isin(quality.EMPTY_DATASET, quality.UNEXPECTED_COLUMNS)
    )


def _misfit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _text(_raw(spark, sf_dir)["order_items"])
    return items.withColumn(
        "price", F.when(_key_mod("order_id", 499), F.lit("n/a")).otherwise(F.col("price"))
    ).withColumn(
        "seller_id",
        F.when(_key_mod("order_id", 503), F.lit("9" * 40)).otherwise(F.col("seller_id")),
    )


def dq_type_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.type_rejects(_misfit_items(spark, sf_dir), CONTRACTS["order_items"])


def dq_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejected value with its record's key."""
    staged = typed.with_rejects(_misfit_items(spark, sf_dir), CONTRACTS["order_items"])
    rows = typed.quarantined(staged, CONTRACTS["order_items"])
    key = F.from_json("record", "order_id string, order_item_id string")
    return rows.select("table", "column", "value", "reason", key["order_id"].alias("order_id"), key["order_item_id"].alias("order_item_id"))


# --- table tests --------------------------------------------------------------------
def _models(spark: SparkSession, sf_dir: str) -> tuple[Mapping[str, DataFrame], Models]:
    raw = _raw(spark, sf_dir)
    return raw, build_models(raw)


def dt_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _models(spark, sf_dir)
    frames = {
        "fact_orders": m["fact_orders"],
        "fact_order_items": m["fact_order_items"],
        "fact_orders_canceled": m["fact_orders"].where(F.col("order_status") == "canceled"),
    }
    return _union(
        [checks.nonempty(df).select(F.lit(k).alias("model"), "empty") for k, df in frames.items()]
    )


def _keyed(df: DataFrame, model: str, cols: list[str]) -> DataFrame:
    failing = checks.unique_columns(df, cols)
    return failing.select(
        F.lit(model).alias("model"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"),
        F.col("n_records").cast("long").alias("n_records"),
    )


def dt_unique_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, m = _models(spark, sf_dir)
    return _union(
        [
            _keyed(m["order_items"], "order_items", ["order_id", "order_item_id"]),
            _keyed(m["fact_order_items"], "fact_order_items", ["order_id", "order_item_id"]),
            _keyed(m["mart_geography_sales"], "mart_geography_sales",
                   ["customer_state", "customer_city"]),
            _keyed(raw["order_reviews"], "raw_order_reviews", ["review_id"]),
        ]
    )


def dt_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _negated_items(_raw(spark, sf_dir))
    return checks.between(items, "price", 0).select("order_id", "order_item_id", "price")


def dt_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _models(spark, sf_dir)
    return checks.not_null(m["dim_products"], "product_category_name").select("product_id")


def dt_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return checks.unique(raw["order_reviews"], "review_id")


def dt_reconcile_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, m = _models(spark, sf_dir)
    return reconcile.reconcile_revenue(raw, m)


def dt_reconcile_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, m = _models(spark, sf_dir)
    return reconcile.reconcile_detail(raw, m)


#: Models that several tested models are built from, in groups that need only earlier ones.
_SHARED_MODELS = (("order_items", "fact_orders"), ("fact_order_items",))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"suite-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def suite_models(raw: Mapping[str, DataFrame]) -> Models:
    """All models; those that others share are written once, not computed again for each."""
    written: dict[str, DataFrame] = {}
    for names in _SHARED_MODELS:
        m = build_models(raw, written)
        written |= run_concurrently({n: (lambda df=m[n], n=n: _written(df, n)) for n in names})
    return build_models(raw, written)


def dt_suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.run_suite(suite_models(_raw(spark, sf_dir)), checks.ALL_TESTS)


# --- sources ----------------------------------------------------------------------
def _landing(spark: SparkSession, raw: Mapping[str, DataFrame], names: list[str],
             rename: Callable[[str], str] | None = None) -> str:
    """Write the named raw tables as the source CSV files into a fresh landing folder."""
    root = scratch_path(spark, "landing")

    def land(name: str) -> None:
        df = raw[name]
        if rename:
            df = df.toDF(*[rename(c) for c in df.columns])
        write_csv(df, f"{root}/{CONTRACTS[name].csv_filename}")

    # The largest shuffle, that of the items, is gone before the other files are written.
    items = [n for n in names if n == "order_items"]
    with short_shuffles(spark):
        for some in (items, [n for n in names if n not in items]):
            run_concurrently({n: (lambda n=n: land(n)) for n in some})
    return root


def src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    root = _landing(spark, raw, ["order_reviews"])
    text = Landing(spark, root).read("order_reviews")
    return typed.to_typed(text, CONTRACTS["order_reviews"])


def src_header_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    root = _landing(spark, raw, ["sellers"], rename=lambda c: f"  {c.upper()} ")
    text = Landing(spark, root).read("sellers")
    return typed.to_typed(text, CONTRACTS["sellers"])


def src_trim_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    root = _landing(spark, raw, ["customers"])
    text = Landing(spark, root, trim=True).read("customers")
    return typed.to_typed(text, CONTRACTS["customers"])


def raw_typed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.to_typed(_text(_raw(spark, sf_dir)["orders"]), CONTRACTS["orders"])


def raw_typed_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.to_typed(_text(_raw(spark, sf_dir)["order_items"]), CONTRACTS["order_items"])


def raw_delivered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.delivered_sample(_raw(spark, sf_dir)["orders"])


def src_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.sample_counts(_raw(spark, sf_dir))


# --- sinks --------------------------------------------------------------------------
def sink_full_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    root = scratch_path(spark, "warehouse")
    contract = CONTRACTS["orders"]
    stale = raw["orders"].where(F.col("order_status") == "shipped")
    reload.load_dataset(stale, contract, root)
    reload.load_dataset(raw["orders"], contract, root)  # replaces, never appends
    return reload.read_table(spark, root, contract.destination_table)


def sink_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _raw(spark, sf_dir)["customers"]
    shaped = customers.drop("customer_unique_id").withColumn("debug_column", F.lit("x"))
    return reload.project_to_contract(shaped, CONTRACTS["customers"])


def sink_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    counts = reload.load_all(raw, CONTRACTS, scratch_path(spark, "warehouse"))
    return spark.createDataFrame(sorted(counts.items()), "table_name string, n_rows long")


def prof_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _models(spark, sf_dir)
    return profiles.view_counts(m)


def prof_heaviest_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.heaviest_product(_raw(spark, sf_dir)["products"])


def out_seller_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _models(spark, sf_dir)
    return records.to_json_records(m["mart_seller_performance"])


def out_category_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _models(spark, sf_dir)
    return records.to_json_records(serving.categories(m))


def out_state_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _models(spark, sf_dir)
    return records.to_json_records(serving.states(m))


# --- refresh ---------------------------------------------------------------------------
def refresh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    landing = _landing(spark, raw, list(CONTRACTS))
    result = run_refresh(spark, landing, scratch_path(spark, "warehouse"), discard_source=True)
    return spark.createDataFrame(result.table_rows(), "table_name string, n_rows long")


QUERIES = {
    fn.__name__: fn
    for fn in (
        dq_missing_columns, dq_duplicate_keys, dq_negative_money, dq_out_of_bounds,
        dq_date_order, dq_null_heavy, dq_report, dq_gate, dq_extract_issues, dq_type_rejects, dq_quarantine,
        dt_nonempty, dt_unique_columns, dt_between, dt_not_null, dt_unique,
        dt_reconcile_revenue, dt_reconcile_detail, dt_suite_summary,
        src_csv_roundtrip, src_header_normalize, src_trim_strings,
        raw_typed_orders, raw_typed_order_items, raw_delivered_sample, src_sample_counts,
        sink_full_reload, sink_projection, sink_row_counts,
        prof_view_counts, prof_heaviest_product, out_seller_json, out_category_json, out_state_json,
        refresh_summary,
    )
}
