"""What a Python worker holds at once: small Arrow batches, slices and indexes."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tradelens.llm import jaccard_join, stored, substring_dedup

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _batch(n_bytes: int) -> pa.RecordBatch:
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    texts, size = [], 0
    while size < n_bytes:
        texts.append(" ".join(rng.choices(words, k=400)))
        size += len(texts[-1])
    ids = pa.array(np.arange(len(texts)))
    return pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], ["doc_id", "text", "text_hash"])


def _peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_entries_of_a_large_batch_are_made_in_small_slices():
    batch = _batch(10 << 20)
    assert _peak(lambda: [None for _ in substring_dedup._entries(iter([batch]), 48)]) < 120  # 202 with slices of 2 MB and batches of 8 MB


def test_points_of_a_large_batch_are_made_in_small_slices():
    batch, common = _batch(4 << 20), np.arange(9, dtype=np.uint64)
    assert _peak(lambda: [None for _ in jaccard_join._points(iter([batch]), 5, 80, common)]) < 12  # 16 with slices of 512 KB


def test_an_index_of_the_usual_size_is_small():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 110, 1 << 20).astype(np.uint8)
    n = substring_dedup.INDEX_BYTES // (substring_dedup.WIDTH + substring_dedup.GRAM)
    at, size = rng.integers(0, len(text) - 80, n), rng.integers(50, 77, n)
    pieces = pa.array([text[a : a + k].tobytes() for a, k in zip(at.tolist(), size.tolist(), strict=True)], pa.binary())
    ids = pa.array(np.arange(n))
    table = pa.table([ids, ids, pa.array(np.zeros(n, np.int64)), pieces], ["doc_id", "text_hash", "lo", "piece"])
    assert _peak(lambda: substring_dedup._match(table)) < 160  # 254 with indexes of 2 MB


def test_written_steps_send_small_batches_and_leave_the_setting(spark):
    own = spark.conf.get(ROWS)
    sizes = spark.range(0, 9000, 1, 1).mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long"
    )
    seen = [r["n"] for r in stored.stored(sizes, "sizes").collect()]
    assert sum(seen) == 9000 and max(seen) <= stored.BATCH_ROWS  # before: one batch of 9000
    assert spark.conf.get(ROWS) == own


def test_proposals_are_made_for_a_few_parts_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    parts, each, groups = 40, 1000, jaccard_join.GROUPS
    n = parts * each
    points = rng.integers(0, 2, (n, groups)).astype("u1")
    points[1::50] = points[::50]
    size = points.sum(axis=1, dtype=np.int64)
    none = pa.array([None] * n, pa.list_(pa.int64()))
    table = pa.table(
        {
            "part": pa.array(np.repeat(np.arange(parts), each)), "side": pa.array(np.full(n, 2, np.int32)),
            "cell": pa.array(np.repeat(np.arange(parts) + 7, each)), "n": pa.array(size), "class": pa.array(np.arange(n)),
            "comp": pa.array(np.arange(n)), "point": pa.array([p.tobytes() for p in points], pa.binary()), "firsts": none, "refuted": none,
        }
    )

    def rows() -> set[tuple]:
        out = jaccard_join._propose(iter(table.to_batches(max_chunksize=2000)), 80, 4)
        return {tuple(r.values()) for b in out for r in b.to_pylist()}

    own, few = _peak(rows), rows()
    print("MB held", own)
    monkeypatch.setattr(jaccard_join, "FLUSH", 40_000)
    assert few == rows() and len(few) > 700
    assert own < 60  # 114 with all parts at once and 2,000 searches at a time
