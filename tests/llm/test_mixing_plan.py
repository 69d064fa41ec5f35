"""Mixing against a plain version: exponent, budgets, cuts and copies."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tradelens.llm import mixing


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for i in range(900):
        source = rng.choices(["big", "mid", "small", None, "none"], [60, 25, 8, 5, 2])[0]
        out.append((i, "" if source == "none" else "w " * rng.randint(0, 40), source))
    return [*out, (900, None, "big"), (5, "again again", "mid"), (None, "no id", "small")]


def plain_plan(rows, flatten):
    """Tokens, exponent and budgets at the corpus's own token count."""
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    live = {s: n for s, n in tokens.items() if n}
    total = sum(live.values())

    def entropy(t):
        z = sum((n / total) ** t for n in live.values())
        return -sum((n / total) ** t / z * math.log((n / total) ** t / z) for n in live.values())

    target = entropy(1) + flatten * (math.log(len(live)) - entropy(1))
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) >= target else (lo, mid)
    z = sum((n / total) ** lo for n in live.values())
    return tokens, lo, {s: math.floor((n / total) ** lo / z * total) for s, n in live.items()}


def test_exponent_budgets_cuts_and_copies(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.plan_mix(docs, flatten=0.5, budget_tokens=0, block_tokens=300)
    tokens, exponent, budgets = plain_plan(rows, 0.5)
    assert 0 < mix.exponent < 1 and abs(mix.exponent - exponent) < 1e-6
    got = {r["_src"]: r for r in mix.sources.collect()}
    name = lambda s: "null" if s is None else f"={s}"
    for s, n in tokens.items():
        assert got[name(s)]["tokens"] == n
        assert abs(got[name(s)]["budget"] - budgets.get(s, 0)) <= 1  # the two exponents differ by 1e-9 or so
    # Cuts and copies follow from the keys: a prefix in the order of block, sub-block and document.
    beside = docs.select("*", mixing.source_key().alias("_src"), F.xxhash64("doc_id", F.lit(mix.seed)).alias("u"), mixing.word_tokens().alias("t"))
    keyed = beside.join(F.broadcast(mix.sources), "_src").withColumns(mixing.order_keys(mix.seed)).collect()
    want = Counter()
    by_source = defaultdict(list)
    for r in keyed:
        by_source[r["_src"]].append(r)
    for source, of in by_source.items():
        epochs, part = got[source]["epochs"], got[source]["part"]
        assert not tokens[of[0]["source"]] or epochs * got[source]["tokens"] + part == got[source]["budget"]
        run, full = 0, False
        in_order = sorted(of, key=lambda r: (r["k1"], r["k2"], r["u"]))
        sums = Counter()
        for r in in_order:
            sums[(r["k1"], r["k2"], r["u"])] += r["t"]
        taken = set()
        for key in sorted(sums):
            full = full or run + sums[key] > part
            if not full:
                run += sums[key]
                taken.add(key)
        for r in of:
            copies = epochs + (part > 0 and (r["k1"], r["k2"], r["u"]) in taken)
            if copies:
                want[(r["doc_id"], r["text"], r["source"])] += copies
    out = mixing.apply_mix(docs, mix).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out) == want
    assert len({r["_block"] for r in out if r["source"] == "big"}) > 1


@pytest.mark.parametrize("extra", [0, 1, 7])
def test_whole_budgets_at_large_counts(spark, extra):
    """At the exponent 1 every source gets exactly its own tokens, at 1e11 tokens a source too."""
    rng = random.Random(extra)
    counts = [rng.randint(10**10, 10**11) for _ in range(200)]
    top, total = max(counts), sum(counts)
    sources = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(counts)], "_src string, tokens long")
    sources = sources.withColumn("l", F.log(F.col("tokens") / F.lit(float(top))))
    for budget in (total, None):
        got = mixing.with_budgets(sources, 1.0, total, 200, top, budget).collect()
        assert all(r["budget"] == r["tokens"] for r in got)
    got = mixing.with_budgets(sources, 1.0, total, 200, top, total * 3 + extra).collect()
    assert all(r["budget"] == r["tokens"] * (total * 3 + extra) // total for r in got)
    assert {r["budget"] for r in mixing.with_budgets(sources, 0.0, total, 200, top, total).collect()} == {total // 200}
    half = mixing.with_budgets(sources, 0.5, total, 200, top, None).collect()
    assert all(r["budget"] >= r["tokens"] for r in half) and max(r["budget"] for r in half) == top


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_registered_target_binds(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    mix = mixing.plan_mix(docs, flatten=0.5, budget_tokens=0)
    assert 0 < mix.exponent < 1
    total = mix.sources.agg(F.sum("tokens"), F.sum("budget")).first()
    assert total[0] - 100 <= total[1] <= total[0]


def test_empty_table_and_arguments(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.apply_mix(docs.limit(0), mixing.plan_mix(docs.limit(0), flatten=0.5, budget_tokens=0)).count() == 0
    with pytest.raises(ValueError):
        mixing.plan_mix(docs, flatten=0.5, max_repeats=2.0)
