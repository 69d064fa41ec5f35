"""The suite's query computes models that others share once, with the same outcome."""

from __future__ import annotations

from fixture import raw_tables
from tradelens import registry_ops
from tradelens.operators.checks import ALL_TESTS, run_suite
from tradelens.plans.models import build_models


def test_shared_models_are_written_once_and_read_by_all_tests(spark, tmp_path, monkeypatch):
    raw = {}
    for name, df in raw_tables(spark).items():
        df.write.parquet(str(tmp_path / name))
        raw[name] = spark.read.parquet(str(tmp_path / name))
    monkeypatch.setattr(registry_ops, "_raw", lambda spark, sf_dir: raw)
    summary = registry_ops.dt_suite_summary(spark, "")
    read = {f.split("/")[-2] for f in summary.inputFiles()}
    assert "order_items" not in read  # before: read again for every table that needs it
    assert "customers" in read and any(x.startswith("suite-fact_order_items") for x in read)
    plain = run_suite(build_models(raw), ALL_TESTS)
    assert sorted(summary.collect()) == sorted(plain.collect()) and summary.count() == len(ALL_TESTS)
