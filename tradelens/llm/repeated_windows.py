"""Substring dedup by words: a count-min prefilter, then exact grouping.

A window is ``width`` consecutive words of one text.  Its key for the sketch is
its anchor, the ``GRAM``-word gram with the smallest hash in it: occurrences of
a window have anchors at equal offsets, so an anchor's count is never below
the counts of the windows around it.

1. Every partition counts its anchors' cells in ``ROWS`` sketch rows; the
   partial sketches are merged by Spark (sparse, so a row may be very wide).
2. Anchors whose smallest cell count is under two are dropped: none of their
   windows can repeat.  The others' runs of windows are grouped exactly: first
   equal runs (all copies of a passage at once), then the windows of distinct
   runs, by 128-bit hashes of their words.

Null text counts as empty; texts shorter than a window lose nothing; equal rows
share their results; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.flat import (
    beside_rows,
    doc_slices,
    flat_text,
    minimizer_runs,
    mix64,
    prefix_sums,
    row_key,
    span_hash,
    window_hashes,
    word_hashes,
    word_spans,
)
from tradelens.llm.stored import stored

#: Words of a window and of an anchor; sketch rows and cells of a row (sparse).
WIDTH, GRAM, ROWS, CELLS_LOG2 = 35, 8, 2, 40


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offsets = flat_text(b.column("text"))
        for lo, hi in doc_slices(offsets):
            part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first = word_spans(part, off)
            grams = window_hashes(word_hashes(part, starts, ends), GRAM)
            begin, count, anchor = minimizer_runs(grams, first, GRAM, width)
            row = np.searchsorted(first, begin, side="right") - 1
            rows, at = np.unique(row, return_index=True)
            cut = pa.array(np.r_[at, len(row)], pa.int32())
            lists = [
                pa.ListArray.from_arrays(cut, pa.array(v, t))
                for v, t in ((grams[anchor].view(np.int64), pa.int64()), (begin - first[row], pa.int32()), (count, pa.int32()))
            ]
            ids = [b.column(c).slice(lo, hi - lo).take(pa.array(rows)) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*ids, *lists], ["doc_id", "text_hash", "anchor", "lo", "n"])


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows with candidate runs -> each run's 128-bit hash; its windows' hashes where first seen in a task."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        buf, offsets = flat_text(b.column("text"))
        for lo, hi in doc_slices(offsets):
            part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first = word_spans(part, off)
            words = word_hashes(part, starts, ends)
            sums = [prefix_sums(words), prefix_sums(mix64(words), 1)]
            runs = b.column("runs").slice(lo, hi - lo)
            size = np.diff(np.array(runs.offsets))
            row = np.repeat(np.arange(hi - lo), size)
            flat = runs.flatten()
            begin, n = flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            at = first[row] + begin
            r = [span_hash(s, at, at + n + width - 1, f) for f, s in enumerate(sums)]
            each = np.repeat(np.arange(len(n)), n)
            place = at[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            w = np.stack([span_hash(s, place, place + width, f) for f, s in enumerate(sums)], axis=1).astype("<u8")
            edges = np.r_[0, np.cumsum(n)].tolist()
            windows = []
            if len(seen) > 1_000_000:
                seen.clear()
            for k, key in enumerate(zip(r[0].tolist(), r[1].tolist(), strict=True)):
                if key in seen:
                    windows.append(None)
                else:
                    seen.add(key)
                    windows.append(w[edges[k] : edges[k + 1]].view(np.int64))
            pairs = [None if x is None else x.tolist() for x in windows]
            ids = [b.column(c).slice(lo, hi - lo).take(pa.array(row)) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays(
                [
                    *ids,
                    pa.array(begin, pa.int32()),
                    pa.array(n, pa.int32()),
                    pa.array(r[0].view(np.int64)),
                    pa.array(r[1].view(np.int64)),
                    pa.array(pairs, pa.list_(pa.list_(pa.int64()))),
                ],
                ["doc_id", "text_hash", "lo", "n", "r1", "r2", "windows"],
            )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, total, gone = [], [], []
        texts = b.column("text").cast(pa.binary()).to_pylist()
        for text, spans in zip(texts, b.column("spans").to_pylist(), strict=True):
            words = text.split()
            total.append(len(words))
            if spans:
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edge[s["a"]] += 1
                    edge[s["b"]] -= 1
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                gone.append(len(words) - len(stay))
                words = [words[i] for i in stay.tolist()]
            else:
                gone.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def merged_sketch(anchors: DataFrame) -> DataFrame:
    """row, cell and count of all cells counted at least twice: partial sums per partition, merged."""
    cells = anchors.select(F.explode("anchor").alias("h")).select(F.posexplode(F.array(*_cells("h"))).alias("row", "cell"))
    return cells.groupBy("row", "cell").agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def _cells(h: str) -> list:
    return [F.expr(f"shiftrightunsigned({h}, {(64 - CELLS_LOG2) * k // (ROWS - 1)}) & {(1 << CELLS_LOG2) - 1}L") for k in range(ROWS)]


def removed_spans(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, spans (word ranges a to b) of the rows with repeated windows."""
    anchors = stored(
        rows.mapInArrow(
            lambda x: _anchors(x, width), "doc_id long, text_hash long, anchor array<long>, lo array<int>, n array<int>"
        ),
        "anchors",
    )
    sketch = stored(merged_sketch(anchors), "sketch")
    each = anchors.select("doc_id", "text_hash", F.explode(F.arrays_zip("anchor", "lo", "n")).alias("e"))
    each = each.select("doc_id", "text_hash", "e.*")
    for k, cell in enumerate(_cells("anchor")):
        row = sketch.where(F.col("row") == k).select(F.col("cell").alias(f"_c{k}"))
        each = each.withColumn(f"_c{k}", cell).join(row, f"_c{k}", "left_semi").drop(f"_c{k}")
    runs = each.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "n")).alias("runs"), F.count(F.lit(1)).alias("k"))
    runs = stored(runs, "candidate-runs")
    size = runs.agg(F.sum("k") * 8 + F.count(F.lit(1)) * 64).first()[0] or 0
    # Equal rows share one list, but each of them counts.
    found = beside_rows(rows, runs.drop("k"), size).where("runs IS NOT NULL")
    hashed = stored(
        found.mapInArrow(
            lambda x: _runs(x, width),
            "doc_id long, text_hash long, lo int, n int, r1 long, r2 long, windows array<array<long>>",
        ),
        "runs",
    )
    classes = stored(hashed.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("copies"), F.max("windows").alias("windows")), "classes")
    windows = classes.select("r1", "r2", "copies", F.posexplode("windows").alias("at", "w"))
    windows = windows.select("r1", "r2", "copies", "at", F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"))
    often = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("times")).where("times > 1")
    single = windows.where("copies = 1").join(often, ["w1", "w2"], "left_semi").groupBy("r1", "r2").agg(F.collect_list("at").alias("at"))
    marks = classes.where("copies > 1").select("r1", "r2", F.lit(None).cast("array<int>").alias("at")).unionByName(single)
    whole = F.array(F.struct(F.col("lo").alias("a"), (F.col("lo") + F.col("n") + width - 1).alias("b")))
    some = F.transform("at", lambda o: F.struct((F.col("lo") + o).alias("a"), (F.col("lo") + o + width).alias("b")))
    spans = hashed.drop("windows").join(marks, ["r1", "r2"]).select("doc_id", "text_hash", F.when(F.col("at").isNull(), whole).otherwise(some).alias("s"))
    return spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("s")).alias("spans"))


def remove_repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the other words joined by a space) of every text."""
    rows = row_key(docs)
    spans = stored(removed_spans(rows, width), "spans")
    size = spans.agg(F.sum(F.size("spans")) * 8 + F.count(F.lit(1)) * 64).first()[0] or 0
    return beside_rows(rows, spans, size).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")
