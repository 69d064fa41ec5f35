"""The fused suite against each test on its own; number of scans and exchanges."""

from __future__ import annotations

import pytest

from tradelens.operators.checks import ALL_TESTS, TableTest, run_suite, suite_passes

ROWS = [
    (1, "a", 5.0), (1, "a", -1.0), (2, None, 3.0), (2, None, None), (None, "b", 9.0), (None, "b", 2.0), (3, "c", 1.0),
]
TESTS = (
    TableTest("t", "nonempty"),
    TableTest("t", "unique", ("k",)),
    TableTest("t", "unique_columns", ("k",)),
    TableTest("t", "unique_columns", ("k", "s")),
    TableTest("t", "unique", ("s",)),
    TableTest("t", "not_null", ("k",)),
    TableTest("t", "not_null", ("s",)),
    TableTest("t", "between", ("x",), 0, 5),
    TableTest("t", "between", ("x",), 0),
    TableTest("e", "nonempty"),
    TableTest("e", "unique", ("k",)),
    TableTest("e", "not_null", ("k",)),
    TableTest("p", "between", ("x",), 2),
)


@pytest.fixture
def tables(spark):
    t = spark.createDataFrame(ROWS, "k long, s string, x double")
    return {"t": t, "e": t.limit(0), "p": t}


def test_fused_counts_equal_single_tests(tables):
    got = {}
    for r in run_suite(tables, TESTS).collect():
        got.setdefault((r["model"], r["kind"], r["columns"]), []).append(r["n_failing"])
    want = {}
    for t in TESTS:
        want.setdefault((t.model, t.kind, ",".join(t.columns)), []).append(t.failing(tables[t.model]).count())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_unknown_kind_fails(tables):
    with pytest.raises(ValueError, match="unknown"):
        run_suite(tables, [TableTest("t", "odd", ("k",))])


def test_declared_suite_is_one_pass_per_table(spark, tmp_dir):
    """44 tests over fourteen written tables: at most fourteen scans, one key exchange each."""
    assert len(ALL_TESTS) == 44 and len(suite_passes(ALL_TESTS)) == 14
    models = {}
    for t in ALL_TESTS:
        models.setdefault(t.model, set()).update(t.columns)
    frames = {}
    for model, columns in models.items():
        names = ", ".join(f"{c} {'double' if 'value' in c or 'score' in c or c in ('price', 'total_revenue', 'late_delivery_rate') else 'string'}" for c in sorted(columns))
        spark.createDataFrame([], names).write.parquet(f"{tmp_dir}/{model}")
        frames[model] = spark.read.parquet(f"{tmp_dir}/{model}")
    summary = run_suite(frames, ALL_TESTS)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 14
    assert plan.count("Exchange hashpartitioning") <= 14
    failing = {r["test"] for r in summary.collect() if r["n_failing"]}
    assert failing == {"nonempty_fact_orders", "nonempty_fact_order_items"}
