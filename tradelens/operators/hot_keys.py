"""Lookup join that keeps frequent and NULL keys out of the shuffle.

Spark's mergeable top-k sketch (one bounded summary per task, merged) finds the
keys above a share of the rows; there are at most ``1 / share`` of them, so
their rows of the dimension are broadcast.  Only the remaining rows are shuffled
by the key, and none of these keys holds more than that share.  Rows without a
key go around the join.  Everything is part of one lazy plan.

The sketch decides only the way a row takes: a key it misses or counts too high
gives the same result by the other way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are broadcast, whatever the number of shuffle partitions.
MAX_HOT_KEYS = 10_000
#: Items the sketch tracks per wanted key (its error is about 3.5 / tracked of the rows).
TRACKED_PER_KEY = 16

_HOT = "__hot_key"


def hot_share(df: DataFrame) -> float:
    """A quarter of a shuffle partition's even share: smaller keys cannot unbalance the join."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1.0 / (4 * max(partitions, 1)), 1.0 / MAX_HOT_KEYS)


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of the rows with a key: at most ``1 / share`` rows."""
    k = min(MAX_HOT_KEYS, max(1, int(1 / share)))
    found = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {k}, {k * TRACKED_PER_KEY})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        found.select(F.explode("top").alias("top"), "n")
        .where(F.col("top.count") >= F.col("n") * F.lit(float(share)))
        .select(F.col("top.item").alias(key))
    )


def lookup_join(
    facts: DataFrame, dim: DataFrame, key: str, columns: Sequence[str], share: float | None = None
) -> DataFrame:
    """``facts`` left-joined with ``columns`` of ``dim`` (one row per ``key``; NULL matches nothing)."""
    share = hot_share(facts) if share is None else share
    wanted = dim.select(key, *columns)
    hot = F.broadcast(hot_keys(facts, key, share))
    hot_rows = wanted.join(hot, key, "left_semi")
    known = hot.join(F.broadcast(hot_rows), key, "left").withColumnRenamed(key, _HOT)
    met = facts.join(F.broadcast(known), F.col(key) == F.col(_HOT), "left")
    around = met.where(F.col(_HOT).isNotNull() | F.col(key).isNull()).drop(_HOT)
    rest = met.where(F.col(_HOT).isNull() & F.col(key).isNotNull()).select(*facts.columns)
    return around.unionByName(rest.join(wanted, key, "left").select(*around.columns))
