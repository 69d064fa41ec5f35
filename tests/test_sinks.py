"""Identifier guard, projection, atomic reload, observed counts, JSON records."""

from __future__ import annotations

import json
import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradelens.contracts import CONTRACTS, ColumnRule, DatasetContract
from tradelens.session import run_concurrently
from tradelens.sinks import records, releases, reload
from pyspark.sql import types as T

A = DatasetContract("a", "a.csv", "raw.a", (("a", ColumnRule(T.LongType())),))


@pytest.mark.parametrize("bad", ["orders", "raw; DROP TABLE--.x", "raw.orders\n", "a.b.c", "1a.b", "_releases.x"])
def test_table_identifier_guard(bad):
    with pytest.raises(ValueError):
        releases.table_folder("wh", bad)


def test_column_identifier_guard(spark):
    c = DatasetContract("a", "a.csv", "raw.a", (("bad col", ColumnRule(T.LongType())),))
    df = spark.createDataFrame([(1,)], "`bad col` long")
    with pytest.raises(ValueError, match="column"):
        reload.project_to_contract(df, c)


def test_load_projects_and_replaces(spark, tmp_dir):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a long, extra string")
    assert reload.load_dataset(df, A, tmp_dir) == 3
    out = reload.read_table(spark, tmp_dir, "raw.a")
    assert out.columns == ["a"] and sorted(r["a"] for r in out.collect()) == [1, 2, 3]
    assert reload.load_dataset(df.where("a = 1"), A, tmp_dir) == 1
    assert reload.read_table(spark, tmp_dir, "raw.a").count() == 1
    assert reload.load_dataset(df.limit(0), A, tmp_dir) == 0


def versions(root, table="raw/a"):
    return sorted(v for v in os.listdir(f"{root}/{table}") if v.startswith("v="))


def test_vacuum_keeps_live_and_growing_versions(spark, tmp_dir):
    df = spark.createDataFrame([(1,)], "a long")
    for _ in range(4):
        reload.load_dataset(df, A, tmp_dir)
    written = versions(tmp_dir)
    assert len(written) == 4  # writing removes nothing
    growing = f"{tmp_dir}/raw/a/v=00000000000000000000-growing"
    os.makedirs(f"{growing}/_temporary/0")
    assert releases.vacuum(spark, tmp_dir, older_than_seconds=3600) == []
    # An old folder of which one file is fresh is still being written.
    old = time.time() - 7200
    open(f"{growing}/_temporary/0/part", "w").close()
    for folder in [*(f"{tmp_dir}/raw/a/{v}" for v in written), growing]:
        for path, _, names in os.walk(folder):
            for name in names if folder != growing else []:
                os.utime(f"{path}/{name}", (old, old))
            os.utime(path, (old, old))
    removed = releases.vacuum(spark, tmp_dir, older_than_seconds=3600)
    assert sorted(os.path.basename(r) for r in removed) == written[:2]
    assert versions(tmp_dir) == sorted([os.path.basename(growing), *written[2:]])
    assert reload.read_table(spark, tmp_dir, "raw.a").count() == 1
    assert releases.live_manifest(spark, tmp_dir).number == 4


def test_second_writer_of_a_table_loses_cleanly(spark, tmp_dir):
    df = spark.createDataFrame([(1,), (2,)], "a long")
    reload.publish(df, tmp_dir, "raw.a")
    first, second = releases.Release(spark, tmp_dir), releases.Release(spark, tmp_dir)
    first.write(df.where("a = 1"), "raw.a")
    second.write(df.where("a = 2"), "raw.a")
    first.commit()
    with pytest.raises(releases.ReleaseConflict, match="raw.a"):
        second.commit()
    assert [r.a for r in reload.read_table(spark, tmp_dir, "raw.a").collect()] == [1]
    assert len(versions(tmp_dir)) == 2  # the loser's folder is gone
    assert releases.live_manifest(spark, tmp_dir).number == 2


def test_writers_of_other_tables_are_carried_over(spark, tmp_dir):
    df = spark.createDataFrame([(1,)], "a long")
    writers = {t: releases.Release(spark, tmp_dir) for t in ("raw.a", "raw.b", "raw.c")}
    for table, release in writers.items():
        release.write(df, table)
    for release in writers.values():
        release.commit()
    live = releases.live_manifest(spark, tmp_dir)
    assert sorted(live) == ["raw.a", "raw.b", "raw.c"] and live.number == 3


def test_a_release_that_read_a_changed_table_conflicts(spark, tmp_dir):
    df = spark.createDataFrame([(1,)], "a long")
    reload.publish(df, tmp_dir, "raw.a")
    release = releases.Release(spark, tmp_dir)
    release.write(release.read("raw.a"), "gold.sum")
    reload.publish(df.union(df), tmp_dir, "raw.a")
    with pytest.raises(releases.ReleaseConflict):
        release.commit()
    assert "gold.sum" not in releases.live_manifest(spark, tmp_dir)


def test_concurrent_commits_get_numbers_of_their_own(spark, tmp_dir):
    df = spark.createDataFrame([(1,)], "a long")
    ready = []
    for k in range(6):
        release = releases.Release(spark, tmp_dir)
        release.write(df, f"raw.t{k}")
        ready.append(release)
    numbers = run_concurrently({k: r.commit for k, r in enumerate(ready)})
    assert sorted(m.number for m in numbers.values()) == [1, 2, 3, 4, 5, 6]
    assert len(releases.live_manifest(spark, tmp_dir)) == 6


def test_readers_keep_their_release(spark, tmp_dir):
    def write(n):
        with releases.Release(spark, tmp_dir) as release:
            for t in ("raw.a", "raw.b"):
                release.write(spark.range(n).toDF("a"), t)
            return release.commit()

    write(3)
    before = releases.Warehouse(spark, tmp_dir)
    write(5)
    assert [before[t].count() for t in before] == [3, 3]
    assert [df.count() for df in releases.Warehouse(spark, tmp_dir).values()] == [5, 5]


def test_a_crash_between_tables_changes_nothing(spark, tmp_dir):
    df = spark.createDataFrame([(1,)], "a long")
    reload.publish(df, tmp_dir, "raw.a")
    with pytest.raises(ZeroDivisionError), releases.Release(spark, tmp_dir) as release:
        release.write(df.union(df), "raw.a")
        release.write(df, "raw.b")
        raise ZeroDivisionError
    assert reload.read_table(spark, tmp_dir, "raw.a").count() == 1
    assert sorted(releases.live_manifest(spark, tmp_dir)) == ["raw.a"] and len(versions(tmp_dir)) == 1


def test_manifest_keeps_rows_and_schema(spark, tmp_dir):
    df = spark.createDataFrame([(Decimal("1.50"), None)], "m decimal(8,2), s string")
    reload.publish(df, tmp_dir, "raw.a")
    live = releases.live_manifest(spark, tmp_dir)["raw.a"]
    assert live.rows == 1
    assert reload.read_table(spark, tmp_dir, "raw.a").schema == df.schema


def test_failed_reload_keeps_old_version(spark, tmp_dir):
    df = spark.createDataFrame([(1,), (2,)], "a long")
    reload.load_dataset(df, A, tmp_dir)
    failing = df.select(F.expr("assert_true(a < 2)").alias("x"), "a").drop("x")
    with pytest.raises(Exception):
        reload.load_dataset(failing.select((F.col("a") / F.lit(0)).cast("long").alias("a")), A, tmp_dir)
    assert sorted(r["a"] for r in reload.read_table(spark, tmp_dir, "raw.a").collect()) == [1, 2]


def test_absent_columns_load_as_null(spark, tmp_dir):
    c = CONTRACTS["customers"]
    df = spark.createDataFrame([("c1", "SP")], "customer_id string, customer_state string")
    projected = reload.project_to_contract(df, c)
    assert projected.columns == list(c.expected_columns)
    row = projected.collect()[0]
    assert row["customer_city"] is None and row["customer_state"] == "SP"


def test_load_all_counts(spark, tmp_dir):
    orders = spark.createDataFrame([("o1",), ("o2",)], "order_id string")
    customers = spark.createDataFrame([("c1",)], "customer_id string")
    counts = reload.load_all({"orders": orders, "customers": customers}, CONTRACTS, tmp_dir)
    assert counts == {"raw.orders": 2, "raw.customers": 1}


def test_json_records_keep_scale_and_nulls(spark):
    df = spark.createDataFrame(
        [("s1", Decimal("1234567890123456.78"), None, 3)],
        "seller_id string, total_revenue decimal(18,2), avg_review_score decimal(4,2), n long",
    )
    rec = json.loads(records.to_json_records(df).collect()[0]["record"])
    assert rec == {"seller_id": "s1", "total_revenue": "1234567890123456.78",
                   "avg_review_score": None, "n": 3}
