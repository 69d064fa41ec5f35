"""First row per key (``DISTINCT ON (key) ... ORDER BY key, a NULLS LAST, ...``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RN = "__first_rn"


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """Keep one row per ``keys``: the first by ``order`` (plain names sort ASC NULLS LAST).

    ``row_number() = 1`` is planned as a ``WindowGroupLimit`` before and after the
    shuffle, so a key holding a large share of the rows collapses to one row per
    map task before it is exchanged.
    """
    cols = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*cols)
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)
