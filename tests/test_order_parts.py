"""Items dealt by order keep their number of partitions, which grows with the input's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.plans import marts
from tradelens.sinks.files import input_bytes


def _items(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("order_id"), (F.col("id") % 7).cast("string").alias("seller_id"), F.lit(1.5).cast("decimal(8,2)").alias("price")
    )


def test_partitions_grow_with_the_files_and_are_not_merged(spark, tmp_path, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = str(tmp_path / "a b")  # a name that is escaped in URIs
    _items(spark, 5000).repartition(3).write.parquet(folder)
    read = spark.read.parquet(folder)
    size = sum(f.stat().st_size for f in (tmp_path / "a b").glob("part-*.parquet"))
    assert input_bytes(read) == size
    monkeypatch.setattr(marts, "PART_BYTES", size // (3 * least))
    parts = marts.order_parts(read)
    assert parts >= 3 * least
    dealt = marts.by_order(read, "seller_id", "price")
    assert dealt.rdd.getNumPartitions() == parts  # before: merged to one
    assert dealt.count() == 5000 and sorted(dealt.collect()) == sorted(read.collect())


def test_rows_without_files_are_left_to_the_session(spark):
    rows = spark.createDataFrame([("1", "a")], "order_id string, seller_id string")
    assert input_bytes(rows) == 0
    assert marts.order_parts(rows) is None
