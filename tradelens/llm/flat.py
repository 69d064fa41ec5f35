"""Flat-buffer helpers for Arrow tasks: texts of a batch as one byte array.

Hashes are polynomial over 64-bit wrap-around integers with a random value per
byte, finished by a mixer, so all substrings or word windows of a buffer are
hashed from one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for a place in a slice beside a hash (a text has fewer than 2^28 items).
PLACE_BITS = 28
#: Measured bytes up to which per-row lists are broadcast.
BROADCAST_BYTES = 1 << 20
#: Bytes of text handled at once inside a task (a longer text is one slice).
SLICE_BYTES = 2 << 20

_U = np.uint64
#: Two odd bases give two independent families of hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null text: empty); other columns cannot clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_sums(values: np.ndarray, family: int = 0) -> np.ndarray:
    """Weighted prefix sums from which ``span_hash`` hashes any range of values."""
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * _powers(BASES[family], len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Hash of values[start:end] for every span; equal spans have equal hashes."""
    inverse = pow(BASES[family], -1, 1 << 64)
    raw = (sums[ends] - sums[starts]) * _powers(inverse, len(sums))[starts]
    return mix64(raw + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def sums_windows(sums: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of every range of ``width`` values, in order."""
    n = max(len(sums) - width, 0)
    raw = sums[width : width + n] - sums[:n]
    raw *= _powers(pow(BASES[0], -1, 1 << 64), n)
    raw += _U(width * 0xA24BAED4963EE407 & (1 << 64) - 1)
    return mix64(raw)


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[buf]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def flat_text(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the offsets of its rows (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    arr = col.cast(pa.large_binary()).fill_null(b"")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, count=n + 1 + arr.offset)[arr.offset :]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def doc_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (at least one row)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each row's first word."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[buf]
    first = np.zeros(n, dtype=bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    begins = ~space
    begins[1:] &= space[:-1] | first[1:]
    stops = ~space
    stops[:-1] &= space[1:] | first[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(byte_values(buf)), starts, ends)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of values[i:i+width] for every i (empty if there are fewer values)."""
    if len(values) < width:
        return np.zeros(0, _U)
    return sums_windows(prefix_sums(values), width)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for every i with a whole window."""
    if len(x) < width:
        return x[:0]
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def within_rows(row_first: np.ndarray, width: int, n_windows: int) -> np.ndarray:
    """Which windows of ``width`` items lie inside one row (row_first: offsets)."""
    row_end = np.repeat(row_first[1:], np.diff(row_first))[:n_windows]
    return np.arange(n_windows) + width <= row_end


def minimizer_runs(grams: np.ndarray, row_first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, numbers of windows and anchor places of all minimizer runs.

    ``grams`` holds the hash of the ``gram`` items from each place on.  A window
    of ``window`` items inside one row has as anchor its gram with the smallest
    hash (the leftmost of equals), so equal windows have equal anchors at equal
    offsets; consecutive windows with the same anchor are one run.
    """
    span = window - gram + 1
    n = len(grams) - span + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    low = _U((1 << PLACE_BITS) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=_U)
    anchor = (sliding_min(packed, span) & low).astype(np.int64)
    inside = within_rows(row_first, window, n)
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    edges = np.flatnonzero(new | ~inside)
    run = np.flatnonzero(new[edges])
    first = edges[run]
    return first, np.r_[edges, n][run + 1] - first, anchor[first]


def row_key(docs: DataFrame) -> DataFrame:
    """id_text with text_hash: id and hash name a row; equal rows share a key and their results."""
    return id_text(docs).withColumn("text_hash", F.xxhash64("text"))


def beside_rows(rows: DataFrame, lists: DataFrame, n_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows left-joined with per-row lists on doc_id (null-safe) and text_hash.

    Lists of up to ``most`` bytes (measured) are broadcast, so texts are
    not shuffled; larger ones meet the rows in a sort-merge join.
    """
    r, x = rows.alias("r"), lists.alias("x")
    on = F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.text_hash") == F.col("x.text_hash"))
    if n_bytes <= most:
        x = F.broadcast(x)
    return r.join(x, on, "left").select("r.*", *[F.col(f"x.{c}") for c in lists.columns if c not in ("doc_id", "text_hash")])
