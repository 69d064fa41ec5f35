"""Neighbours of any ids, many rows of one id, and likenesses, against plain versions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tradelens.llm import merkle

LEAST = -(1 << 63)


def leaves(text):
    """Distinct leaves by a plain walk over sections and paragraphs."""
    out = set()
    for section in text.split("\n\n"):
        for p in section.split("\n"):
            n, stop = (merkle.PIECE, r"?(?:[.!?]\s+|\Z)") if len(p) > merkle.SHORT else (merkle.SHORT_PIECE, r"(?:\s+|\Z)")
            out |= {m.group(0) for m in re.finditer(rf"(?s).{{1,{n}}}{stop}|.{{1,{n}}}", p, re.ASCII)}
    return out


def like(a, b):
    a, b = leaves(a), leaves(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("heavy", [4096, 3])
def test_neighbours_of_any_ids(spark, monkeypatch, heavy):
    """Sparse, negative, adjacent, extreme, repeated and null ids; repeated rows; cells split by hash when ids are heavy."""
    monkeypatch.setattr(merkle, "HEAVY", heavy)
    rng = random.Random(heavy)
    ids = [rng.randrange(LEAST, -LEAST) for _ in range(300)] + list(range(-300, 700)) + [LEAST, -LEAST - 1] + [500] * 30 + [None] * 300
    rows = [(k, f"text {rng.randrange(10**9)}") for k in ids]
    rows += rng.choices(rows, k=40) + [(None, "")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ties = {r.text: r.tie for r in df.select("text", F.xxhash64("text").alias("tie")).distinct().collect()}
    order = sorted(rows, key=lambda r: (LEAST if r[0] is None else r[0], ties[r[1]]), reverse=True)
    want = sorted(((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order)), key=repr)
    got = merkle.neighbours(df, ["text"])
    assert got.columns == ["doc_id", "text", "next_text"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_one_document_is_its_own_neighbour(spark):
    df = spark.createDataFrame([(None, "alone")], "doc_id long, text string")
    assert [tuple(r) for r in merkle.neighbours(df, ["text"]).collect()] == [(None, "alone", "alone")]


def test_likeness(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta. ", "so!\n", "end.\n\n"]) for _ in range(n))
    rows = [(i * 10**15, say(rng.choice([0, 1, 5, 60, 400]))) for i in range(60)] + [(7, "y" * 2_000_000), (8, "One line. " * 200_000)]
    got = {r.doc_id: r for r in merkle.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[k].near_edited == pytest.approx(like(t, edited)), k
        assert got[k].near_next == pytest.approx(like(t, nxt)), k
