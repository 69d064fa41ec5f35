"""Exact means, rates, ratios and delays against Python's Decimal arithmetic."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext


from pyspark.sql import functions as F

from tradelens.functions import delay_days, exact_mean, exact_ratio, flag_rate


def half_up(x: Decimal, places: int) -> Decimal:
    return x.quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)


def exact(values: list[Decimal]) -> Decimal | None:
    vals = [v for v in values if v is not None]
    if not vals:
        return None
    with localcontext() as ctx:
        ctx.prec = 60
        return sum(vals) / Decimal(len(vals))


def test_means_rates_and_ratios_round_once_half_up(spark):
    rng = random.Random(7)
    rows = []
    groups: dict[int, list] = {}
    # planted exact ties: 2.625, 5.875, -0.125 and an all-NULL group
    planted = [[Decimal("2.50"), Decimal("2.75")], [Decimal("5.875")], [Decimal("-0.125")], [None]]
    for g, vals in enumerate(planted):
        groups[g] = vals
    for g in range(len(planted), 400):
        n = rng.randint(1, 8)
        groups[g] = [
            None if rng.random() < 0.1 else Decimal(rng.randint(-50000, 200000)).scaleb(-2)
            for _ in range(n)
        ]
    for g, vals in groups.items():
        for i, v in enumerate(vals):
            rows.append((g, v, i % 3 == 0, i % 2 == 0, Decimal(i + 1)))
    df = spark.createDataFrame(rows, "g int, v decimal(12,3), late boolean, eligible boolean, w decimal(12,0)")
    got = {
        r["g"]: r
        for r in df.groupBy("g").agg(
            exact_mean("v", 2).alias("m2"),
            exact_mean("v", 4).alias("m4"),
            flag_rate("late", "eligible").alias("rate"),
            exact_ratio("sum(v)", "sum(w)", 2).alias("ratio"),
        ).collect()
    }
    for g, vals in groups.items():
        m = exact(vals)
        assert got[g]["m2"] == (None if m is None else half_up(m, 2)), (g, vals)
        assert got[g]["m4"] == (None if m is None else half_up(m, 4)), (g, vals)
        flags = [(i % 3 == 0) for i in range(len(vals)) if i % 2 == 0]
        rate = exact([Decimal(int(f)) for f in flags])
        assert got[g]["rate"] == (None if rate is None else half_up(rate, 4))
        num = sum((v for v in vals if v is not None), Decimal(0))
        den = sum(Decimal(i + 1) for i in range(len(vals)))
        with localcontext() as ctx:
            ctx.prec = 60
            want = half_up(num / den, 2) if any(v is not None for v in vals) else None
        assert got[g]["ratio"] == want, (g, vals)
    assert got[0]["m2"] == Decimal("2.63")
    assert got[1]["m2"] == Decimal("5.88")
    assert got[2]["m2"] == Decimal("-0.13")
    assert got[3]["m2"] is None


def test_delay_days_are_signed_fractional_days(spark):
    base = dt.datetime(2020, 1, 10)
    deltas = [dt.timedelta(days=2), dt.timedelta(days=-2), dt.timedelta(hours=3),
              dt.timedelta(hours=-27, minutes=30), dt.timedelta(0)]
    df = spark.createDataFrame(
        [(base + d, base) for d in deltas] + [(None, base)],
        "actual timestamp_ntz, estimate timestamp_ntz",
    )
    got = [r[0] for r in df.select(delay_days("actual", "estimate")).collect()]
    for d, value in zip(deltas, got):
        with localcontext() as ctx:
            ctx.prec = 40
            want = Decimal(int(d.total_seconds() * 1_000_000)) / Decimal(86_400_000_000)
        assert abs(value - want) < Decimal("1e-12")
    assert got[-1] is None


def test_two_level_mean_equals_one_level(spark):
    from tradelens.functions import mean_of_sums, wide_sum

    rng = random.Random(11)
    rows = []
    for g in range(300):
        for i in range(rng.randint(1, 12)):
            v = None if rng.random() < 0.15 else Decimal(rng.randint(-99999, 999999)).scaleb(-3)
            rows.append((g, i % 4, v))
    df = spark.createDataFrame(rows, "g int, sub int, v decimal(12,3)")
    one = {r["g"]: r["m"] for r in df.groupBy("g").agg(exact_mean("v", 2).alias("m")).collect()}
    parts = df.groupBy("g", "sub").agg(wide_sum("v").alias("s"), F.expr("count(v)").alias("n"))
    two = {r["g"]: r["m"] for r in parts.groupBy("g").agg(mean_of_sums("s", "n", 2).alias("m")).collect()}
    assert one == two
