"""Reusable table tests: each returns the failing rows (empty = pass).

``run_suite`` evaluates a list of declared tests and returns one row per test
with its number of failing rows.  All tests of a table are compiled into one
pass: row conditions are summed per key group, group conditions over the groups,
so a table with one set of tested keys is scanned and shuffled once, whatever
the number of its tests (each further key set adds a pass of its own).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nonempty(df: DataFrame) -> DataFrame:
    """One row when ``df`` has none (reads at most one row of it)."""
    probe = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return probe.where(F.col("n") == 0).select(F.lit(1).alias("empty"))


def unique_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key tuples that occur more than once; NULLs group as equal."""
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .where(F.col("n_records") > 1)
    )


def unique(df: DataFrame, column: str) -> DataFrame:
    """Non-NULL values that occur more than once."""
    return unique_columns(df.where(F.col(column).isNotNull()), [column])


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def between(df: DataFrame, column: str, minimum, maximum=None) -> DataFrame:
    """Rows outside ``[minimum, maximum]`` (inclusive; NULL passes; no upper bound if None)."""
    return df.where(_outside(F.col(column), minimum, maximum))


def _outside(c: Column, minimum, maximum) -> Column:
    cond = c < F.lit(minimum)
    if maximum is not None:
        cond = cond | (c > F.lit(maximum))
    return cond


@dataclass(frozen=True)
class TableTest:
    """A declared test: ``kind`` in nonempty, unique_columns, unique, not_null, between."""

    model: str
    kind: str
    columns: tuple[str, ...] = ()
    minimum: float | int | None = None
    maximum: float | int | None = None

    @property
    def name(self) -> str:
        cols = "__".join(self.columns)
        return "_".join(p for p in (self.kind, self.model, cols) if p)

    def failing(self, df: DataFrame) -> DataFrame:
        if self.kind == "nonempty":
            return nonempty(df)
        if self.kind == "unique_columns":
            return unique_columns(df, self.columns)
        if self.kind == "unique":
            return unique(df, self.columns[0])
        if self.kind == "not_null":
            return not_null(df, self.columns[0])
        if self.kind == "between":
            return between(df, self.columns[0], self.minimum, self.maximum)
        raise ValueError(f"unknown test kind {self.kind!r}")


def _nn_unique(model: str, column: str) -> list[TableTest]:
    return [TableTest(model, "not_null", (column,)), TableTest(model, "unique", (column,))]


def _between(model: str, column: str, lo, hi=None) -> TableTest:
    return TableTest(model, "between", (column,), lo, hi)


# The declared suite of the published models (44 tests; the revenue
# reconciliation is the 45th, see ``plans/reconcile.py``).
SILVER_TESTS: tuple[TableTest, ...] = (
    *_nn_unique("category_translation", "product_category_name"),
    *_nn_unique("orders", "order_id"),
    TableTest("order_items", "unique_columns", ("order_id", "order_item_id")),
    TableTest("order_items", "not_null", ("order_id",)),
    TableTest("order_items", "not_null", ("order_item_id",)),
    _between("order_items", "price", 0),
    _between("order_items", "freight_value", 0),
    *_nn_unique("order_review_summary", "order_id"),
    _between("order_review_summary", "avg_review_score", 1, 5),
    *_nn_unique("order_payment_summary", "order_id"),
    _between("order_payment_summary", "total_payment_value", 0),
    *_nn_unique("order_item_summary", "order_id"),
)
GOLD_TESTS: tuple[TableTest, ...] = (
    *_nn_unique("dim_customers", "customer_id"),
    *_nn_unique("dim_sellers", "seller_id"),
    *_nn_unique("dim_products", "product_id"),
    TableTest("fact_orders", "nonempty"),
    *_nn_unique("fact_orders", "order_id"),
    _between("fact_orders", "avg_review_score", 1, 5),
    TableTest("fact_order_items", "nonempty"),
    TableTest("fact_order_items", "unique_columns", ("order_id", "order_item_id")),
    TableTest("fact_order_items", "not_null", ("order_id",)),
    TableTest("fact_order_items", "not_null", ("order_item_id",)),
    *_nn_unique("mart_seller_performance", "seller_id"),
    _between("mart_seller_performance", "total_revenue", 0),
    _between("mart_seller_performance", "avg_review_score", 1, 5),
    _between("mart_seller_performance", "late_delivery_rate", 0, 1),
    *_nn_unique("mart_category_performance", "product_category"),
    _between("mart_category_performance", "total_revenue", 0),
    _between("mart_category_performance", "avg_review_score", 1, 5),
    _between("mart_category_performance", "late_delivery_rate", 0, 1),
    TableTest("mart_geography_sales", "unique_columns", ("customer_state", "customer_city")),
    _between("mart_geography_sales", "total_revenue", 0),
    _between("mart_geography_sales", "avg_review_score", 1, 5),
)
ALL_TESTS: tuple[TableTest, ...] = SILVER_TESTS + GOLD_TESTS


def _key_set(test: TableTest) -> tuple[str, ...]:
    return test.columns if test.kind in ("unique", "unique_columns") else ()


def _row_failures(test: TableTest) -> Column:
    """1 for a row that fails a row test, else 0."""
    c = F.col(f"`{test.columns[0]}`")
    bad = c.isNull() if test.kind == "not_null" else F.coalesce(_outside(c, test.minimum, test.maximum), F.lit(False))
    return F.when(bad, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _group_failures(test: TableTest) -> Column:
    """1 for a key group that fails a uniqueness test, else 0 (``unique`` skips NULL)."""
    bad = F.col("__n") > 1
    if test.kind == "unique":
        bad = bad & F.col(f"`{test.columns[0]}`").isNotNull()
    return F.when(bad, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _table_pass(df: DataFrame, tests: Sequence[TableTest]) -> DataFrame:
    """One row per test of one table, from one pass; the tests name at most one key set."""
    keys = next((_key_set(t) for t in tests if _key_set(t)), ())
    by_row = {f"__r{i}": t for i, t in enumerate(tests) if t.kind in ("not_null", "between")}
    by_group = {f"__g{i}": t for i, t in enumerate(tests) if _key_set(t)}
    sums = [F.sum(_row_failures(t)).alias(name) for name, t in by_row.items()]
    groups = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__n"), *sums)
    if keys:
        flags = [_group_failures(t).alias(name) for name, t in by_group.items()]
        groups = groups.select("__n", *by_row, *flags)
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("__n", *by_row, *by_group)])

    def result(i: int, t: TableTest) -> Column:
        if t.kind == "nonempty":
            return F.when(F.col("__n") == 0, F.lit(1)).otherwise(F.lit(0))
        return F.col(f"__r{i}" if f"__r{i}" in by_row else f"__g{i}")

    rows = [
        F.struct(
            F.lit(t.name).alias("test"),
            F.lit(t.model).alias("model"),
            F.lit(t.kind).alias("kind"),
            F.lit(",".join(t.columns)).alias("columns"),
            result(i, t).cast("long").alias("n_failing"),
        )
        for i, t in enumerate(tests)
    ]
    return total.select(F.inline(F.array(*rows)))


def suite_passes(tests: Sequence[TableTest]) -> list[list[TableTest]]:
    """The passes of a suite: per table, all tests with the first key set, then each further key set."""
    known = {"nonempty", "not_null", "between", "unique", "unique_columns"}
    bad = sorted({t.kind for t in tests} - known)
    if bad:
        raise ValueError(f"unknown test kind(s) {bad}")
    passes: dict[tuple[str, tuple[str, ...]], list[TableTest]] = {}
    first: dict[str, tuple[str, ...]] = {}
    for t in tests:
        if _key_set(t):
            first.setdefault(t.model, _key_set(t))
    for t in tests:
        keys = _key_set(t) or first.get(t.model, ())
        passes.setdefault((t.model, keys), []).append(t)
    return list(passes.values())


def run_suite(models: Mapping[str, DataFrame], tests: Sequence[TableTest]) -> DataFrame:
    """One row per test (test, model, kind, columns, n_failing) as one DataFrame."""
    out = None
    for group in suite_passes(tests):
        part = _table_pass(models[group[0].model], group)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a suite needs at least one test")
    return out


class TableTestError(AssertionError):
    """A declared table test has failing rows."""


def assert_suite(summary: DataFrame) -> list[dict]:
    """Collect a suite summary (one row per test) and raise if any test fails."""
    rows = [r.asDict() for r in summary.collect()]
    failed = [r for r in rows if r["n_failing"] > 0]
    if failed:
        raise TableTestError(
            "failing tests: " + ", ".join(f"{r['test']} ({r['n_failing']})" for r in failed)
        )
    return rows
