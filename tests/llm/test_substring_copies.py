"""Runs that recur inside one text reach the index once, and in many small tasks."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tests.llm import brute
from tradelens.llm import substring_dedup
from tradelens.llm.run_index import RunLengthIndex


def _phrase(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("abcdefgh ", k=n))


def _repeating(rng: random.Random) -> list[tuple[int | None, str | None]]:
    """Texts that repeat phrases inside themselves, whole or in part beside others' ones."""
    phrases = [_phrase(rng, rng.randint(20, 130)) for _ in range(8)]
    docs: list[tuple[int | None, str | None]] = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 7)):
            p = rng.choice(phrases)
            cut = rng.choice([p, p[rng.randint(0, 10) :], p[: rng.randint(40, 130)], _phrase(rng, rng.randint(1, 60))])
            parts.append(cut * rng.choice([1, 1, 2, 5]))
        docs.append((k, "".join(parts)))
    docs += [(3, docs[9][1]), (7, docs[7][1]), (None, docs[5][1] * 2), (None, None), (61, "é" * 90 + docs[2][1]), (62, "xy" * 80), (63, "xy" * 90)]
    rng.shuffle(docs)
    return docs


def test_texts_with_repeats_inside_equal_the_plain_version(spark):
    for seed in (1, 2):
        docs = _repeating(random.Random(seed))
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.remove_repeats(df).collect()], key=str)
        assert got == brute.substring(docs)


def test_a_run_repeated_inside_a_text_is_one_piece():
    rng = random.Random(4)
    phrase = _phrase(rng, 120)
    texts = [phrase * 40, phrase[:70] + _phrase(rng, 50)]
    ids = pa.array([1, 2], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], ["doc_id", "text", "text_hash"])
    settled = substring_dedup._settle(pa.Table.from_batches(list(substring_dedup._entries(iter([batch]), 1))))
    wanted = dict(zip(settled["doc_id"].to_pylist(), settled["wanted"].to_pylist(), strict=True))
    copies = dict(zip(settled["doc_id"].to_pylist(), settled["copies"].to_pylist(), strict=True))
    assert wanted[1] and len(copies[1]) >= 20 * len(wanted[1])  # before: every copy was a piece of its own


def test_an_index_grows_in_proportion():
    rng = np.random.default_rng(2)
    size = np.full(4000, 66)
    text = rng.integers(97, 101, size.sum()).astype(np.uint8)
    index = RunLengthIndex(text, np.r_[0, np.cumsum(size)], np.arange(4000), 50)
    held = sum(v.nbytes for v in vars(index).values() if isinstance(v, np.ndarray))
    assert held < 60 * len(text)  # 67 with 64-bit places


def test_matching_is_dealt_to_given_tasks(spark):
    packed = spark.range(48).selectExpr("cast(id as int) AS shard", "id")
    plan = substring_dedup._by_shard(packed, 48).applyInArrow(lambda t: t, "shard int, id long")
    assert plan.count() == 48
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and "ENSURE_REQUIREMENTS" not in text.replace("SinglePartition, ENSURE_REQUIREMENTS", "")
