"""Exact decimal means, ratios and delays.

Averages of decimals in Spark carry scale ``s + 4`` and a later ``round`` rounds a
second time, which moves exact ties.  Every mean and ratio here is computed with
at least 14 fractional digits, snapped to 10 (``HALF_UP``), then rounded once to
the published scale, so ``2.625`` becomes ``2.63`` and a rate of ``0.45745`` is
not turned into ``0.4575`` by an intermediate rounding.

Arguments are SQL expressions over the frame's columns (a plain column name is
the simplest one); each helper is one SQL expression, i.e. one JVM call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(28,14)"
SNAP = "decimal(28,10)"
MICROS_PER_DAY = 86_400_000_000


def exact_avg(expr: str) -> Column:
    """Unrounded mean of a numeric expression, 18 fractional digits (NULLs skipped)."""
    return F.expr(f"avg(cast(({expr}) as {WIDE}))")


def exact_mean(expr: str, scale: int) -> Column:
    """``round(avg(expr), scale)`` without double rounding; NULL when no non-NULL value."""
    return F.expr(f"round(cast(avg(cast(({expr}) as {WIDE})) as {SNAP}), {int(scale)})")


def wide_sum(expr: str) -> Column:
    """Partial sum for a two-level mean: ``sum(cast(expr as decimal(28,14)))``."""
    return F.expr(f"sum(cast(({expr}) as {WIDE}))")


def mean_of_sums(total: str, count: str, scale: int) -> Column:
    """Combine partial sums and counts into ``exact_mean``'s result.

    ``avg`` on decimals is the sum (``decimal(38,14)``) divided by the count
    cast to ``decimal(20,0)``; this does the same division on summed parts, so
    a mean computed in two levels equals the one computed in one.
    """
    return F.expr(
        f"round(cast(sum({total}) / cast(nullif(sum({count}), 0) as decimal(20,0))"
        f" as {SNAP}), {int(scale)})"
    )


def exact_ratio(num: str, den: str, scale: int) -> Column:
    """``round(num / nullif(den, 0), scale)`` on decimals, NULL for a zero denominator."""
    return F.expr(
        f"round(cast(cast(({num}) as decimal(30,4)) / cast(nullif(({den}), 0) as decimal(20,0))"
        f" as {SNAP}), {int(scale)})"
    )


def flag_rate(flag: str, eligible: str, scale: int = 4) -> Column:
    """Mean of 1/0 of ``flag`` over the rows where ``eligible`` holds (SQL ``FILTER``)."""
    return exact_mean(
        f"CASE WHEN ({eligible}) THEN CASE WHEN ({flag}) THEN 1 ELSE 0 END END", scale
    )


def delay_days(actual: str, estimate: str) -> Column:
    """Signed fractional days ``actual - estimate`` as a decimal (NULL if either is NULL)."""
    return F.expr(
        f"cast(cast(timestampdiff(MICROSECOND, `{estimate}`, `{actual}`) as decimal(20,0))"
        f" / cast({MICROS_PER_DAY} as decimal(12,0)) as decimal(28,13))"
    )
