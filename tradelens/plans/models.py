"""The fourteen published models, wired from the raw tables.

``build_models`` only composes lazy plans: nothing runs until an action.  The
``layer`` of each model and its inputs form the lineage (see ``lineage.py``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tradelens.plans import gold, marts, silver
from tradelens.sinks.releases import Manifest, Warehouse

SILVER = "silver"
GOLD = "analytics"

# model -> (layer, inputs); raw inputs are written ``raw.<table>``.
LINEAGE: dict[str, tuple[str, tuple[str, ...]]] = {
    "orders": (SILVER, ("raw.orders",)),
    "order_items": (SILVER, ("raw.order_items",)),
    "category_translation": (SILVER, ("raw.category_translation",)),
    "order_payment_summary": (SILVER, ("raw.order_payments",)),
    "order_review_summary": (SILVER, ("raw.order_reviews",)),
    "order_item_summary": (SILVER, ("order_items",)),
    "dim_customers": (GOLD, ("raw.customers",)),
    "dim_sellers": (GOLD, ("raw.sellers",)),
    "dim_products": (GOLD, ("raw.products", "category_translation")),
    "fact_orders": (GOLD, ("orders", "order_review_summary")),
    "fact_order_items": (GOLD, ("order_items", "order_payment_summary")),
    "mart_seller_performance": (GOLD, ("dim_sellers", "fact_orders", "fact_order_items")),
    "mart_category_performance": (GOLD, ("dim_products", "fact_orders", "fact_order_items")),
    "mart_geography_sales": (GOLD, ("dim_customers", "fact_orders", "order_item_summary")),
}

# Published beside the models: state that several answers are computed from.
SUPPORT: dict[str, tuple[str, tuple[str, ...]]] = {
    "region_totals": (GOLD, ("dim_customers", "fact_orders", "order_item_summary")),
}

# What a model is built from, where that is a support table in place of the lineage's inputs.
_INPUTS = {"mart_geography_sales": ("region_totals",)}


def inputs_of(model: str) -> tuple[str, ...]:
    return _INPUTS.get(model) or (LINEAGE.get(model) or SUPPORT[model])[1]


_BUILDERS = {
    "orders": silver.orders,
    "order_items": silver.order_items,
    "category_translation": silver.category_translation,
    "order_payment_summary": silver.order_payment_summary,
    "order_review_summary": silver.order_review_summary,
    "order_item_summary": silver.order_item_summary,
    "dim_customers": gold.dim_customers,
    "dim_sellers": gold.dim_sellers,
    "dim_products": gold.dim_products,
    "fact_orders": gold.fact_orders,
    "fact_order_items": gold.fact_order_items,
    "mart_seller_performance": marts.mart_seller_performance,
    "mart_category_performance": marts.mart_category_performance,
    "mart_geography_sales": marts.mart_geography_sales,
    "region_totals": marts.region_totals,
}

MODEL_ORDER: tuple[str, ...] = tuple(LINEAGE)


class Models(Mapping[str, DataFrame]):
    """Read-only mapping model name -> DataFrame, built lazily on first access.

    Only the models a query touches (and their inputs) are ever constructed,
    each once; ``overrides`` stand in for models that are already materialised.
    """

    def __init__(self, raw: Mapping[str, DataFrame],
                 overrides: Mapping[str, DataFrame] | None = None):
        self._env: dict[str, DataFrame] = {f"raw.{k}": v for k, v in raw.items()}
        self._built: dict[str, DataFrame] = dict(overrides or {})

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self._built:
            if key not in _BUILDERS:
                raise KeyError(key)
            inputs = [self._env[d] if d.startswith("raw.") else self[d] for d in inputs_of(key)]
            self._built[key] = _BUILDERS[key](*inputs)
        return self._built[key]

    def __iter__(self):
        return iter(MODEL_ORDER)

    def __len__(self) -> int:
        return len(MODEL_ORDER)

    def __getattr__(self, key: str) -> DataFrame:
        if key.startswith("_"):
            raise AttributeError(key)
        try:
            return self[key]
        except KeyError as exc:
            raise AttributeError(key) from exc


def qualified(model: str) -> str:
    return f"{(LINEAGE.get(model) or SUPPORT[model])[0]}.{model}"


def build_model(name: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Build one model from a mapping holding its inputs (``raw.x`` or model names)."""
    return _BUILDERS[name](*[inputs[d] for d in inputs_of(name)])


def build_models(
    raw: Mapping[str, DataFrame], overrides: Mapping[str, DataFrame] | None = None
) -> Models:
    """All models over the raw tables (``raw`` keyed by table name, unqualified).

    ``overrides`` replaces a model by an existing frame, e.g. a materialised
    Parquet table, so that downstream models read it instead of recomputing it.
    """
    return Models(raw, overrides)


class PublishedModels(Models):
    """All models of one release of a warehouse; row counts and schemas come from its manifest."""

    def __init__(self, warehouse: Warehouse):
        self._warehouse = warehouse
        tables = {m: qualified(m) for m in (*MODEL_ORDER, *SUPPORT) if qualified(m) in warehouse}
        raw = {t[4:]: warehouse[t] for t in warehouse if t.startswith("raw.")}
        super().__init__(raw, {m: warehouse[t] for m, t in tables.items()})

    @property
    def manifest(self) -> Manifest:
        return self._warehouse.manifest

    def rows(self, model: str) -> int | None:
        """Rows of a published model without a scan; None if the release lacks it."""
        found = self.manifest.get(qualified(model))
        return None if found is None else found.rows


def published_models(spark: SparkSession, root: str) -> PublishedModels:
    """The models of the live release, all of that release whatever is committed later."""
    return PublishedModels(Warehouse(spark, root))


def register_catalog(spark: SparkSession, root: str) -> list[str]:
    """Catalog views ``schema.table`` over the live release; their names.

    Every session of the application (every user of a shared metastore) can then
    query ``silver.orders`` or ``analytics.mart_geography_sales`` by name.  The
    views are replaced together after each release; views of tables that the
    release lacks are dropped.
    """
    warehouse = Warehouse(spark, root)
    names = []
    for schema in sorted({t.split(".")[0] for t in warehouse}):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
        there = {r["viewName"] for r in spark.sql(f"SHOW VIEWS IN `{schema}`").collect() if not r["isTemporary"]}
        live = {t.split(".")[1] for t in warehouse if t.startswith(f"{schema}.")}
        for gone in sorted(there - live):
            spark.sql(f"DROP VIEW `{schema}`.`{gone}`")
    for table in warehouse:
        schema, name = table.split(".")
        path = warehouse.manifest[table].path(root, table).replace("`", "``")
        spark.sql(f"CREATE OR REPLACE VIEW `{schema}`.`{name}` AS SELECT * FROM parquet.`{path}`")
        names.append(table)
    return names


def register_models(models: Mapping[str, DataFrame]) -> list[str]:
    """Temporary views ``silver_<model>`` and ``analytics_<model>`` for SQL users; their names.

    Views are lazy: a SQL query plans only the models it names.
    """
    names = []
    for model in MODEL_ORDER:
        layer = "silver" if LINEAGE[model][0] == "silver" else "analytics"
        models[model].createOrReplaceTempView(f"{layer}_{model}")
        names.append(f"{layer}_{model}")
    return names
