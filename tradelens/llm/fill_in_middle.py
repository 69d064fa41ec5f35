"""Fill-in-middle transformation by displacement scatter, and its inverse.

A text of n code points is cut twice; the pieces are put out in another order
behind marks.  All texts of a slice lie in one byte array.  A scan turns cuts in
code points into byte places; a difference array holds, at the first byte of
every piece, by how much its displacement differs from the piece before, so one
cumulative sum gives every byte its way to the output and one scatter moves
them all.  Restoring finds the marks in the outputs, builds the displacements
over the restored bytes likewise and gathers.

Forms: ``psm`` is P prefix S suffix M middle, ``spm`` is S suffix P prefix M
middle; a text stays ``plain`` if it is empty, contains a mark, or is not drawn.
Draws come from the hex SHA-256 of ``<seed>:<doc_id>``, so a document's form and
cuts depend on its id and length only.

Null text counts as empty (plain, empty output); a null id draws as an empty
id; repeated rows give one row each; empty tables give empty results; other
columns are ignored.  A text is handled whole, however long: memory is a few
times the longest text or ``SLICE_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.flat import doc_slices, flat_text, id_text

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Order of prefix (0), suffix (1) and middle (2) in the output.
ORDER = {PSM: (0, 1, 2), SPM: (1, 0, 2)}

_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def cut_places(buf: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points per row, and byte places of each row's cuts (given in code points)."""
    begins = np.flatnonzero((buf & 0xC0) != 0x80)
    first = np.searchsorted(begins, offsets)
    place = np.r_[begins, len(buf)][np.minimum(first[:-1, None] + cuts, len(begins))]
    return np.diff(first), np.where(first[:-1, None] + cuts >= first[1:, None], offsets[1:, None], place)


def _displaced(starts: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """Shift of each of n bytes; rows of ``starts`` are consecutive pieces, empty ones included."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts.ravel(), np.diff(shifts.ravel(), prepend=0))
    return np.cumsum(steps[:n])


def scatter(
    buf: np.ndarray, offsets: np.ndarray, places: np.ndarray, order: np.ndarray, marks: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Output bytes and offsets of all rows.

    ``places`` holds two byte places a row; ``order`` the pieces (0 prefix, 1
    suffix, 2 middle) in output order, or -1 in the first column for a plain row.
    """
    rows = len(order)
    plain = order[:, 0] < 0
    starts = np.c_[offsets[:-1], places]  # of prefix, middle, suffix, as they lie in the text
    sizes = np.diff(np.c_[starts, offsets[1:]], axis=1)[:, [0, 2, 1]]  # of prefix, suffix, middle
    mark_sizes = np.array([len(m) for m in marks])
    out_offsets = np.r_[0, np.cumsum(np.diff(offsets) + np.where(plain, 0, mark_sizes.sum()))]
    target = np.zeros((rows, 3), np.int64)  # output place of each piece's first byte
    out = np.zeros(out_offsets[-1], np.uint8)
    at, row = out_offsets[:-1].copy(), np.arange(rows)
    for k in range(3):
        piece = np.maximum(order[:, k], 0)
        for m, mark in enumerate(marks):
            here = at[~plain & (piece == m)]
            out[here[:, None] + np.arange(len(mark))] = mark
        target[row, piece] = at + mark_sizes[piece]
        at += mark_sizes[piece] + sizes[row, piece]
    shifts = target[:, [0, 2, 1]] - starts
    shifts[plain] = (out_offsets[:-1] - offsets[:-1])[plain, None]
    out[np.arange(len(buf)) + _displaced(starts, shifts, len(buf))] = buf
    return out, out_offsets


def gather(
    out: np.ndarray, out_offsets: np.ndarray, order: np.ndarray, marks: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """The texts and their offsets, from outputs and forms alone."""
    rows = len(order)
    plain = order[:, 0] < 0
    mark_sizes = np.array([len(m) for m in marks])
    found = np.zeros((rows, 3), np.int64)  # output place behind each piece's mark
    for m, mark in enumerate(marks):
        hit = np.ones(max(len(out) - len(mark) + 1, 0), bool)
        for j, byte in enumerate(mark):
            hit &= out[j : j + len(hit)] == byte
        spots = np.flatnonzero(hit)
        # A mark at the row's start, or where the piece before it ends: the first hit inside the row.
        first = np.searchsorted(spots, out_offsets[:-1])
        found[:, m] = np.r_[spots, len(out)][first] + len(mark)
    order = np.where(plain[:, None], np.arange(3), order)
    row = np.arange(rows)
    ends = np.zeros((rows, 3), np.int64)
    for k in range(3):
        after = found[row, order[:, k + 1]] - mark_sizes[order[:, k + 1]] if k < 2 else out_offsets[1:]
        ends[row, order[:, k]] = after
    sizes = ends - found
    sizes[plain] = 0
    sizes[plain, 0] = np.diff(out_offsets)[plain]
    found[plain, 0] = out_offsets[:-1][plain]
    offsets = np.r_[0, np.cumsum(sizes.sum(axis=1))]
    starts = offsets[:-1, None] + np.c_[np.zeros(rows, np.int64), sizes[:, 0], sizes[:, 0] + sizes[:, 2]]
    shifts = found[:, [0, 2, 1]] - starts
    n = int(offsets[-1])
    return out[np.arange(n) + _displaced(starts, shifts, n)], offsets


def _orders(forms: np.ndarray) -> np.ndarray:
    order = np.full((len(forms), 3), -1, np.int64)
    for form, pieces in ORDER.items():
        order[forms == form] = pieces
    return order


def _binary(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]
    ).cast(pa.binary())


def _mark_bytes(marks: tuple[str, ...]) -> list[np.ndarray]:
    return [np.frombuffer(m.encode(), np.uint8) for m in marks]


def fill_in_middle(
    docs: DataFrame, *, percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, seed: int = 1
) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars (null: plain), output (UTF-8 bytes).

    ``percent`` of the texts are transformed, ``spm_percent`` of them suffix first.
    Marks are three different strings of the same kind as the default: an opening
    character that occurs nowhere else in a mark, and a closing one likewise.
    """
    if any(m[0] in m[1:] or m[-1] in m[:-1] for m in marks) or len({m[0] for m in marks} | {m[-1] for m in marks}) != 2:
        raise ValueError("marks must share one opening and one closing character, which occur only there")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = _mark_bytes(marks)
        for b in batches:
            _, all_offsets = flat_text(b.column("text"))
            for lo, hi in doc_slices(all_offsets):
                part = b.slice(lo, hi - lo)
                buf, offsets = flat_text(part.column("text"))
                h = [part.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
                n, _ = cut_places(buf, offsets, np.zeros((hi - lo, 2), np.int64))
                cuts = np.sort(np.c_[h[0] % (n + 1), h[1] % (n + 1)], axis=1)
                marked = part.column("marked").to_numpy(zero_copy_only=False)
                plain = (n == 0) | marked | (h[2] % 100 >= percent)
                forms = np.where(plain, PLAIN, np.where(h[3] % 100 < spm_percent, SPM, PSM))
                _, places = cut_places(buf, offsets, cuts)
                out, out_offsets = scatter(buf, offsets, places, _orders(forms), sought)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(forms, pa.string()),
                        pa.array(cuts[:, 0], pa.int64(), mask=plain),
                        pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain),
                        _binary(out, out_offsets),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    rows = id_text(docs).withColumn("_digest", digest).select("doc_id", "text", *draws, marked.alias("marked"))
    return rows.mapInArrow(run, _OUT)


def restore(made: DataFrame, *, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``made`` with ``restored`` (UTF-8 bytes): the text rebuilt from ``output`` and ``form`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = _mark_bytes(marks)
        for b in batches:
            _, all_offsets = flat_text(b.column("output"))
            for lo, hi in doc_slices(all_offsets):
                part = b.slice(lo, hi - lo)
                out, out_offsets = flat_text(part.column("output"))
                forms = np.array(part.column("form").to_pylist(), dtype=object)
                text, offsets = gather(out, out_offsets, _orders(forms), sought)
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(text, offsets)], [*part.schema.names, "restored"])

    return made.mapInArrow(run, _OUT + ", restored binary")
