"""What a refresh leaves on disk while it runs: no shuffles of ended steps, no landed scratch."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from fixture import raw_tables
from tradelens import registry_ops
from tradelens.contracts import CONTRACTS
from tradelens.operators.quality import DataQualityError
from tradelens.plans import refresh
from tradelens.plans.refresh import run_refresh
from tradelens.session import short_shuffles
from tradelens.sources.landing import write_csv

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffles(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}


def _land(raw, root):
    for name, df in raw.items():
        write_csv(df.coalesce(1), f"{root}/{CONTRACTS[name].csv_filename}")


def test_shuffle_files_go_with_their_query(spark, tmp_dir):
    own = spark.conf.get(CLEANUP, None)
    before = _shuffles(spark)
    wide = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    with short_shuffles(spark):
        wide.write.parquet(f"{tmp_dir}/short")
        wide.write.parquet(f"{tmp_dir}/again")  # the frame can be written again
    assert not _shuffles(spark) - before
    assert spark.conf.get(CLEANUP, None) == own
    assert spark.read.parquet(f"{tmp_dir}/again").count() == 7
    wide.write.parquet(f"{tmp_dir}/long")
    assert _shuffles(spark) - before  # so without the setting they stay


def test_a_refresh_holds_neither_ended_shuffles_nor_discarded_sources(spark, tmp_dir, monkeypatch):
    raw = raw_tables(spark)
    _land(raw, f"{tmp_dir}/kept")
    _land(raw, f"{tmp_dir}/landing")
    before = _shuffles(spark)
    plain = run_refresh(spark, f"{tmp_dir}/kept", f"{tmp_dir}/wh")
    assert not _shuffles(spark) - before  # those of all layers stayed until the driver collected its garbage
    assert len(os.listdir(f"{tmp_dir}/kept")) == len(CONTRACTS)  # a caller's own files stay
    left = []
    gate = refresh.gate
    monkeypatch.setattr(refresh, "gate", lambda issues: left.append(os.listdir(f"{tmp_dir}/landing")) or gate(issues))
    result = run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh2", discard_source=True)
    assert result.table_rows() == plain.table_rows() and left == [[]]


def test_discarding_takes_only_the_datasets_that_are_reloaded(spark, tmp_dir, monkeypatch):
    _land({k: v for k, v in raw_tables(spark).items() if k in ("sellers", "customers")}, f"{tmp_dir}/landing")
    monkeypatch.setattr(refresh.Release, "read", lambda self, table: None)  # the raw tables that are not reloaded

    def stop(issues):
        raise DataQualityError("stop")

    monkeypatch.setattr(refresh, "gate", stop)
    with pytest.raises(DataQualityError, match="stop"):
        run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh", datasets=["sellers"], discard_source=True)
    assert os.listdir(f"{tmp_dir}/landing") == [CONTRACTS["customers"].csv_filename]


def test_rejected_values_are_still_quarantined_without_their_source(spark, tmp_dir):
    raw = raw_tables(spark)
    items = raw["order_items"].withColumn("price", F.lit("n/a"))
    _land({**raw, "order_items": items}, f"{tmp_dir}/landing")
    with pytest.raises(DataQualityError, match="rejected value"):
        run_refresh(spark, f"{tmp_dir}/landing", f"{tmp_dir}/wh", discard_source=True)


def test_items_land_before_the_other_files(spark, monkeypatch):
    order = []
    monkeypatch.setattr(registry_ops, "write_csv", lambda df, path: order.append(path.rsplit("/", 1)[-1]))
    registry_ops._landing(spark, raw_tables(spark), list(CONTRACTS))
    assert order[0] == CONTRACTS["order_items"].csv_filename and len(order) == len(CONTRACTS)
