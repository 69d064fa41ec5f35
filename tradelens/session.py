"""Spark session settings and the shared checkpoint / scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job of the library relies on: ANSI arithmetic (overflow fails
# instead of wrapping), UTC for any zoned value, AQE for runtime join choice,
# partition coalescing and skew splitting.
#
# Broadcast policy: no join is broadcast from a *static* estimate (file sizes
# and guessed selectivities can be far off for compressed, filtered inputs).
# AQE broadcasts a side only after its shuffle stage has run and its exact
# size is known to be under the threshold; everything else stays a sort-merge
# join, with AQE's skew split for hot keys.
LIBRARY_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
}


def local_session(app: str = "tradelens", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench (UI off, small shuffle width)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("TRADELENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in LIBRARY_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one only where none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared file system and is used
    as is.  Only a local session without it (a test, a laptop) gets a fresh
    scratch directory so that lineage can still be cut; on a cluster, where the
    driver's own folder is no use to executors, its absence is an error.
    """
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tradelens-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries started inside delete their shuffle files when they end; afterwards the setting is as before.

    Otherwise the files stay until the driver happens to collect its garbage, so a
    run of many steps holds the shuffles of most of them on disk at once.
    """
    own = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, own)


# Independent writes (tables of one dependency level) are submitted as
# concurrent Spark jobs, one driver thread each; the scheduler interleaves
# their tasks, so small tables do not leave the cluster idle.
MAX_CONCURRENT_JOBS = 8


def run_concurrently(tasks: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Run independent job-submitting callables on driver threads; results by key."""
    if len(tasks) <= 1:
        return {k: fn() for k, fn in tasks.items()}
    with ThreadPoolExecutor(max_workers=min(MAX_CONCURRENT_JOBS, len(tasks))) as pool:
        futures = {k: pool.submit(fn) for k, fn in tasks.items()}
        return {k: f.result() for k, f in futures.items()}
