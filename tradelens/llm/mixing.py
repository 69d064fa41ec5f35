"""Mixing sources to target weights by temperature.

Each source's token share is raised to an exponent between 0 and 1.  The
exponent is bisected until the mixture's entropy meets a target, or until no
source is repeated more often than a limit; five halvings are evaluated by one
grouped job.  The normalised weights become token budgets, and a budget is
realised as whole epochs over the source plus a part of one: the source's
documents are dealt into blocks, blocks are permuted by a seeded hash, and
the part takes blocks in that order up to the budget, then sub-blocks of the
block that crosses it, then documents.

Only DataFrame work.  A source is never gathered: blocks are summed with map
side combination, every window runs over at most ``blocks`` sums of a source,
and a document's copies follow from one row per source.

Null text counts as empty (no tokens, copied like any other); a null source is
a source of its own; a source without tokens keeps one copy of each document;
rows with the same doc_id share their fate; empty tables give empty results;
extra columns are kept by ``apply_mix`` and ignored elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.session import ensure_checkpoint_dir

#: Source tables of up to so many rows (about 100 bytes each) are broadcast.
BROADCAST_SOURCES = 100_000
_SECTIONS = 32


def source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def word_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def beside_source(rows: DataFrame, table: DataFrame, few: bool, salt: Column) -> DataFrame:
    """Rows beside their source's row; many sources are met over 16 salts."""
    if few:
        return rows.join(F.broadcast(table), "_src")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(16)).cast("int")).join(salted, ["_src", "_salt"]).drop("_salt")


@dataclass(frozen=True)
class Mix:
    """sources: one row per source with its weight, budget, epochs and cuts."""

    sources: DataFrame
    few: bool
    exponent: float
    seed: int


def _bisect(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None) -> float:
    """The largest exponent whose entropy reaches the target, or the smallest within the limit.

    ``l`` is the log of a source's tokens over the largest source's.
    """
    lo, hi = 0.0, 1.0

    def sums(at: list[float]) -> list[tuple[float, float]]:
        cols = [c for k, t in enumerate(at) for c in (F.sum(F.exp(t * F.col("l"))).alias(f"z{k}"), F.sum(F.col("l") * F.exp(t * F.col("l"))).alias(f"m{k}"))]
        row = sources.where("tokens > 0").agg(*cols).first()
        return [(row[f"z{k}"], row[f"m{k}"]) for k in range(len(at))]

    edge = sources.where("tokens > 0").agg(F.min("l").alias("low"), F.max("tokens").alias("top")).first()
    if edge["low"] is None:
        return 1.0

    def flat_enough(t: float, z: float, m: float) -> bool:
        if target_entropy is not None:
            return math.log(z) - t * m / z >= target_entropy
        scale = 1.0 if budget is None else budget / (edge["top"] * z)
        return math.exp((t - 1.0) * edge["low"]) * scale > max_repeats

    for _ in range(6):
        at = [lo + (hi - lo) * k / _SECTIONS for k in range(_SECTIONS + 1)]
        holds = [flat_enough(t, z, m) for t, (z, m) in zip(at, sums(at), strict=True)]
        last = max((k for k, h in enumerate(holds) if h), default=None)
        if last is None:
            return lo if target_entropy is None else 0.0
        if last == _SECTIONS:
            return 1.0
        lo, hi = at[last], at[last + 1]
    return lo if target_entropy is not None else hi


def _budget(spend: float, top: int) -> Column:
    """Whole tokens of a source's share of ``spend``; the source of ``top`` is taken exactly once and none less."""
    share = F.floor(F.col("weight") * spend + 1e-6).cast("long")
    return F.when(F.col("tokens") == top, F.col("tokens")).otherwise(F.greatest("tokens", share))


def with_budgets(sources: DataFrame, exponent: float, total: int, live: int, top: int, budget: int | None) -> DataFrame:
    """Sources (tokens, l) with weight and budget in whole tokens.

    ``total`` tokens of ``live`` sources with any, the largest of ``top``.  At the
    exponents 1 and 0 shares are exact fractions and budgets are computed in whole
    numbers, so a source whose share is its own tokens gets exactly these;
    in between the weights are no fractions and doubles decide.  Without a budget
    the largest source is taken exactly once and no source less than once.
    """
    z = sources.where("tokens > 0").agg(F.sum(F.exp(exponent * F.col("l")))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.exp(exponent * F.col("l")) / z).otherwise(0.0)
    sources = sources.withColumn("weight", weight)
    if budget is None:
        share = _budget(float(top) * z, top)
        share = F.col("tokens") if exponent == 1.0 else F.lit(top).cast("long") if exponent == 0.0 else share
    elif exponent == 1.0:
        share = F.expr(f"cast(cast(tokens as decimal(19,0)) * cast({budget} as decimal(19,0)) div {max(total, 1)} as bigint)")
    elif exponent == 0.0:
        share = F.lit(budget // max(live, 1)).cast("long")
    else:
        share = F.floor(F.col("weight") * float(budget)).cast("long")
    return sources.withColumn("budget", F.when(F.col("tokens") > 0, share).otherwise(F.lit(0).cast("long")))


def natural_entropy(sources: DataFrame) -> float:
    """Entropy of the sources' own token shares."""
    row = sources.where("tokens > 0").agg(F.sum(F.exp("l")).alias("z"), F.sum(F.col("l") * F.exp("l")).alias("m")).first()
    return math.log(row["z"]) - row["m"] / row["z"] if row["z"] else 0.0


def plan_mix(
    docs: DataFrame,
    target_entropy_share: float | None = None,
    flatten: float | None = None,
    max_repeats: float | None = None,
    budget_tokens: int | None = None,
    block_tokens: int = 100_000,
    blocks: int = 1024,
    seed: int = 17,
) -> Mix:
    """Weights, budgets and cuts of every source.

    Give one of ``target_entropy_share`` (of the log of the number of sources),
    ``flatten`` (part of the way from the entropy of the sources' own shares to
    that of equal ones) and ``max_repeats``.  Without ``budget_tokens`` the largest source is taken
    exactly once, so every document stays; a budget of 0 stands for the
    corpus's own token count.
    """
    if sum(x is not None for x in (target_entropy_share, flatten, max_repeats)) != 1:
        raise ValueError("give one of target_entropy_share, flatten and max_repeats")
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(
        source_key().alias("_src"), F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("u"), word_tokens().alias("n_tokens")
    ).checkpoint()
    totals = rows.groupBy("_src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")).checkpoint()
    facts = totals.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), F.max("tokens").alias("top"), F.sum((F.col("tokens") > 0).cast("int")).alias("live")).first()
    few, top = facts["n"] <= BROADCAST_SOURCES, max(facts["top"] or 1, 1)
    total, live = int(facts["all"] or 0), int(facts["live"] or 0)
    budget = total if budget_tokens == 0 else None if budget_tokens is None else int(budget_tokens)
    sources = totals.withColumn("l", F.log(F.greatest(F.col("tokens"), F.lit(1)) / F.lit(float(top))))
    target = None if max_repeats is not None else (target_entropy_share or 0.0) * math.log(max(live, 1))
    if flatten is not None:
        own = natural_entropy(sources)
        target = own + flatten * (math.log(max(live, 1)) - own)
    exponent = _bisect(sources, target, max_repeats, budget)
    sources = with_budgets(sources, exponent, total, live, top, budget).withColumn(
        "epochs", F.when(F.col("tokens") > 0, F.expr("cast(budget div tokens as int)")).otherwise(1)
    )
    sources = sources.withColumn("part", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(-1)).withColumn(
        "n_blocks", F.least(F.lit(blocks), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens))).cast("int")
    )
    sources = sources.select("_src", "tokens", "n_docs", "weight", "budget", "epochs", "part", "n_blocks").checkpoint()

    keyed = beside_source(rows, sources.select("_src", "epochs", "part", "n_blocks"), few, F.col("u")).where("part > 0")
    keyed = keyed.withColumns(order_keys(seed, blocks))
    cut1, inside = _cut(keyed, ["_src", "part"], "k1", few)
    cut2, inside = _cut(inside, ["_src", "part"], "k2", few)
    last = inside.groupBy("_src", "part", "u").agg(F.sum("n_tokens").alias("t"))
    running = Window.partitionBy("_src").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    cut3 = last.withColumn("run", F.sum("t").over(running)).where("run <= part").groupBy("_src").agg(F.max("u").alias("cut3"))
    out = sources.join(cut1.select("_src", "cut1"), "_src", "left").join(cut2.select("_src", "cut2"), "_src", "left").join(cut3, "_src", "left")
    return Mix(out.checkpoint(), few, exponent, seed)


def order_keys(seed: int, blocks: int = 1024) -> dict[str, Column]:
    """block; k1: its place in the permutation of the part epoch; k2: a sub-block's."""
    block = F.pmod(F.col("u"), F.col("n_blocks")).cast("int")
    sub = F.pmod(F.xxhash64(F.col("u"), F.lit(seed + 1)), F.lit(blocks)).cast("int")
    return {
        "block": block,
        "k1": F.xxhash64(F.lit(seed), F.col("_src"), F.col("epochs"), block),
        "k2": F.xxhash64(F.lit(seed + 2), F.col("_src"), F.col("epochs"), sub),
    }


def _cut(rows: DataFrame, by: list[str], key: str, few: bool) -> tuple[DataFrame, DataFrame]:
    """The unit in which a source's running sum first exceeds its part, and that unit's rows with what is left."""
    units = rows.groupBy(*by, key).agg(F.sum("n_tokens").alias("t"))
    running = Window.partitionBy("_src").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("run", F.sum("t").over(running)).where("run > part")
    cut = units.groupBy("_src").agg(F.min_by(F.struct(F.col(key).alias("c"), (F.col("part") - F.col("run") + F.col("t")).alias("left")), key).alias("e"))
    cut = cut.select("_src", F.col("e.c").alias(f"cut{key[1]}"), F.col("e.left").alias("left")).checkpoint()
    inside = beside_source(rows, cut, few, F.col("u")).where(F.col(key) == F.col(f"cut{key[1]}"))
    inside = inside.drop("part", f"cut{key[1]}").withColumnRenamed("left", "part")
    return cut, inside


def apply_mix(docs: DataFrame, mix: Mix, blocks: int = 1024) -> DataFrame:
    """Each document once per copy: its columns, then _epoch, _block and _order.

    Sorting by _epoch, _order gives each epoch's blocks in permuted order.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), source_key().alias("_src"), F.xxhash64(F.col("doc_id"), F.lit(mix.seed)).alias("u"))
    rows = beside_source(rows, mix.sources.select("_src", "epochs", "part", "n_blocks", "cut1", "cut2", "cut3"), mix.few, F.col("u"))
    rows = rows.withColumns(order_keys(mix.seed, blocks))
    before = (F.col("k1") < F.col("cut1")) | (
        (F.col("k1") == F.col("cut1")) & ((F.col("k2") < F.col("cut2")) | ((F.col("k2") == F.col("cut2")) & (F.col("u") <= F.col("cut3"))))
    )
    copies = F.col("epochs") + F.when((F.col("part") > 0) & F.coalesce(before, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("_copies", copies).where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    order = F.xxhash64(F.lit(mix.seed), F.col("_src"), F.col("_epoch") - 1, F.col("block"))
    return rows.select("_doc.*", "_epoch", F.col("block").alias("_block"), order.alias("_order"))
