"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tradelens.session import ensure_checkpoint_dir, short_shuffles
from tradelens.sinks.files import Files

#: Rows of an Arrow batch at most while a table is written: a Python worker holds two batches of texts at a time.
BATCH_ROWS = 2_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside send at most ``BATCH_ROWS`` rows at a time to Python; afterwards the setting is as before."""
    own = int(spark.conf.get(_ROWS))
    spark.conf.set(_ROWS, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, str(own))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet below spark.checkpoint.dir and read again: compact, and lineage ends here."""
    spark: SparkSession = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    with small_batches(spark), short_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that no later plan reads."""
    for df in tables:
        base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/{base.rsplit('/', 1)[-1]}/" in folder:
                Files(df.sparkSession, folder).delete(folder)
