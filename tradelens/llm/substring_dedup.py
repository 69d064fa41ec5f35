"""Substring dedup over bytes with run-length indexes.

A byte goes if a ``WIDTH``-byte string covering it also starts in a document
with a smaller id.  Every such string holds an anchor: its ``GRAM``-byte gram
with the smallest hash, at the same offset wherever the string occurs.

1. Each text's runs of windows with one anchor are dealt to shards by the
   anchor's hash, packed by batch.  A shard settles equal runs (all but the
   smallest id are marked whole).
2. Where one anchor has several different runs, the run of the smallest id of
   each is cut from its text (once: further copies of it inside the text are
   noted by their places), and shards of these pieces build a run-length
   index (``run_index``), stream the pieces' matching statistics through it
   and mark the windows of full matches whose class starts in a smaller id.
3. Marks return to the documents, which give those of a piece to its copies
   and drop the covered bytes.

Null text counts as empty; a null id is larger than all others; rows with equal
ids are not earlier than each other; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from tradelens.llm.flat import (
    PLACE_BITS,
    beside_rows,
    byte_values,
    doc_slices,
    flat_text,
    minimizer_runs,
    prefix_sums,
    row_key,
    span_hash,
    sums_windows,
)
from tradelens.llm.run_index import RunLengthIndex
from tradelens.llm.stored import stored

WIDTH, GRAM = 50, 24
#: Text bytes per packed batch and per shard of anchors, piece bytes per index; shards at least.
BATCH_BYTES, SHARD_BYTES, INDEX_BYTES, LEAST_SHARDS = 4 << 20, 16 << 20, 1 << 19, 48
#: Indexes of one task (about a second's work).
TASK_INDEXES = 4
#: Bytes of text hashed at once (a longer text is one slice): small slices stay in the cache and bound a worker's arrays.
SLICE = 1 << 19
_LAST = np.iinfo(np.int64).max
#: Bits for a run's number of windows (at most WIDTH - GRAM + 1) beside two places.
_COUNT_BITS = 7


def _entries(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, docs, entries): the runs of a batch, column by column, by their anchors' shard."""
    parts = (b.slice(lo, hi - lo) for b in batches for lo, hi in doc_slices(flat_text(b.column("text"))[1], BATCH_BYTES))
    for b in parts:
        buf, offsets = flat_text(b.column("text"))
        ids = b.column("doc_id").fill_null(_LAST).to_numpy()
        hashes = b.column("text_hash").to_numpy()
        found = []
        for lo, hi in doc_slices(offsets, SLICE):
            part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            values = byte_values(part)
            sums = prefix_sums(values)
            grams = sums_windows(sums, GRAM)
            begin, n, anchor = minimizer_runs(grams, off, GRAM, WIDTH)
            row = np.searchsorted(off, begin, side="right") - 1
            run = span_hash(sums, begin, begin + n + WIDTH - 1)
            found.append((grams[anchor], run, (row + lo).astype("<u4"), (begin - off[row]).astype("<u4"), n.astype("u1")))
        if not found:
            continue
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        shard = ((cols[0] >> np.uint64(20)) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.uint32)
        order = np.argsort(shard, kind="stable")
        h, r, doc, first, n = (c[order] for c in cols)
        shard = shard[order]
        edges = np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1])][: len(doc)]
        used = doc[new]  # the documents of each shard, ascending as the entries are
        base = np.r_[0, np.cumsum(new)][edges]
        local = np.cumsum(new) - 1 - np.repeat(base[:-1], np.diff(edges))
        rows = []
        for s in np.flatnonzero(np.diff(edges)).tolist():
            own, docs = slice(edges[s], edges[s + 1]), used[base[s] : base[s + 1]]
            kind = np.uint16 if len(docs) < 1 << 16 else np.uint32
            doc_rows = ids[docs].astype("<i8").tobytes() + hashes[docs].astype("<i8").tobytes()
            entries = [c[own].tobytes() for c in (h, r, first, n)] + [local[own].astype(kind).tobytes()]
            rows.append((s, doc_rows, b"".join(entries), own.stop - own.start))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int32()), strict=True)],
                ["shard", "docs", "entries", "k"],
            )


def _unpacked(t: pa.Table) -> tuple[np.ndarray, ...]:
    """All entries of a shard: anchor, run hash, first window, windows, document; ids and hashes of documents."""
    cols: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
    base = 0
    for docs, raw, k in zip(t["docs"], t["entries"], t["k"].to_pylist(), strict=True):
        docs, raw = docs.as_buffer(), raw.as_buffer()
        n = len(docs) // 16
        at = 0
        for c, kind in enumerate(("<u8", "<u8", "<u4", "u1", "<u2" if n < 1 << 16 else "<u4")):
            v = np.frombuffer(raw, kind, k, at)
            at += v.nbytes
            cols[c].append(v if c < 4 else v.astype(np.int64) + base)
        both = np.frombuffer(docs, "<i8")
        cols[5].append(both[:n])
        cols[6].append(both[n:])
        base += n
    return tuple(np.concatenate(c) for c in cols)


def _doc_rows(
    ids: np.ndarray, hashes: np.ndarray, doc: np.ndarray, mark: np.ndarray, lo: np.ndarray, n: np.ndarray, g: np.ndarray, source: np.ndarray
) -> pa.Table:
    """One row per document: marks and wanted pieces as lists of (lo, n) packed, with the pieces' groups.

    Runs with a ``source`` (or else -1) are copies of the document's run there, packed as (lo, source, n).
    """
    packed = (lo.astype(np.int64) << 8) | n
    order = np.lexsort((packed, doc))
    doc, mark, packed, g, source = doc[order], mark[order], packed[order], g[order], source[order]
    copy = source >= 0
    copies = (packed >> 8 << PLACE_BITS + _COUNT_BITS) | (source << _COUNT_BITS) | (packed & 255)
    who = np.unique(doc)
    lists = []
    for keep, values in ((mark, packed), (~mark & ~copy, packed), (~mark & ~copy, g), (copy, copies)):
        cut = np.searchsorted(doc[keep], np.r_[who, _LAST])
        lists.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values[keep], pa.int64())))
    doc_ids = pa.array(ids[who], pa.int64(), mask=ids[who] == _LAST)
    return pa.Table.from_arrays([doc_ids, pa.array(hashes[who], pa.int64()), *lists], ["doc_id", "text_hash", "marks", "wanted", "groups", "copies"])


def _settle(t: pa.Table) -> pa.Table:
    h, r, lo, n, doc, ids, hashes = _unpacked(t)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    order = order[np.r_[False, same] | np.r_[same, False]]  # anchors of one entry say nothing
    order = order[np.lexsort((r[order], h[order]))]
    h, r, lo, n, doc = h[order], r[order], lo[order], n[order], doc[order]
    if not len(h):
        return _doc_rows(ids, hashes, doc, np.zeros(0, bool), lo, n, np.zeros(0, np.int64), doc)
    owner = ids[doc]
    new_h = np.r_[True, h[1:] != h[:-1]]
    new_r = new_h | np.r_[True, r[1:] != r[:-1]]
    run = np.cumsum(new_r) - 1
    low = np.minimum.reduceat(owner, np.flatnonzero(new_r))[run]
    start = np.flatnonzero(new_h)
    runs_of_anchor = np.add.reduceat(new_r.astype(np.int64), start)[np.cumsum(new_h) - 1]
    mark = owner > low
    keep = mark | (runs_of_anchor > 1)
    g = (h >> np.uint64(1)).view(np.int64)
    source = np.full(len(h), -1)
    wanted = np.flatnonzero(keep & ~mark)
    if len(wanted):
        at = wanted[np.lexsort((lo[wanted], doc[wanted], run[wanted]))]
        again = np.r_[False, (run[at[1:]] == run[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])]
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
        source[at[again]] = lo[at[first[again]]]
    return _doc_rows(ids, hashes, doc[keep], mark[keep], lo[keep], n[keep], g[keep], source[keep])


def _pieces(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offsets = flat_text(b.column("text"))
        wanted, groups = b.column("wanted"), b.column("groups")
        size = np.diff(np.array(wanted.offsets))
        row = np.repeat(np.arange(len(wanted)), size)
        packed = wanted.flatten().to_numpy()
        lo, n = packed >> 8, packed & 255
        first, length = offsets[:-1][row] + lo, n + WIDTH - 1
        ends = np.cumsum(length)
        source = np.repeat(first - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lo), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(buf[source])]
        ).cast(pa.binary())
        shard = pa.array((groups.flatten().to_numpy() >> 7) % shards, pa.int32())
        ids = [b.column(c).take(pa.array(row)) for c in ("doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays([shard, *ids, pa.array(lo, pa.int64()), pieces], ["shard", "doc_id", "text_hash", "lo", "piece"])


def _match(t: pa.Table) -> pa.Table:
    text, first = flat_text(t["piece"])
    ids, hashes = t["doc_id"].fill_null(_LAST).to_numpy(), t["text_hash"].to_numpy()
    size = np.diff(first)
    index = RunLengthIndex(text, first, ids, WIDTH)
    width = int(size.max())
    row, at, owner = [], [], []
    for a in range(0, len(size), 1 << 13):
        part = size[a : a + (1 << 13)]
        patterns = np.zeros((len(part), width), np.int64)
        inside = np.arange(width)[None, :] < part[:, None]
        patterns[inside] = text[first[a] : first[a + len(part)]]
        _, owners = index.stream(patterns, part)
        i, j = np.nonzero(owners >= 0)
        row.append(i + a)
        at.append(j)
        owner.append(owners[i, j])
    i, j, owner = np.concatenate(row), np.concatenate(at), np.concatenate(owner)
    late = owner < ids[i]
    i, j = i[late], j[late]
    lo = t["lo"].to_numpy()[i] + j
    ones = np.ones(len(i), np.int64)
    return _doc_rows(ids, hashes, i, np.ones(len(i), bool), lo, ones, ones, -ones).select(["doc_id", "text_hash", "marks"])


def _gone(size: int, marks: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Which of a text's bytes its marked windows cover, those of copied runs included."""
    edge = np.zeros(size + 1, np.int32)
    if len(copies):
        np.add.at(edge, marks >> 8, 1)
        np.add.at(edge, (marks >> 8) + (marks & 255), -1)
        window = np.cumsum(edge) > 0
        n = copies & (1 << _COUNT_BITS) - 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        source = np.repeat(copies >> _COUNT_BITS & (1 << PLACE_BITS) - 1, n) + step
        window[(np.repeat(copies >> PLACE_BITS + _COUNT_BITS, n) + step)[window[source]]] = True
        lo = np.flatnonzero(window)
        edge[:] = 0
        edge[lo] = 1
        edge[lo + WIDTH] -= 1
    else:
        np.add.at(edge, marks >> 8, 1)
        np.add.at(edge, (marks >> 8) + (marks & 255) + WIDTH - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch], whole_chars: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, marks, copies in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("marks"), b.column("copies"), strict=True):
            if marks.is_valid and len(marks.values):
                gone = _gone(len(text), marks.values.to_numpy(), copies.values.to_numpy())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                if whole_chars:
                    kept = kept.decode("utf-8", "ignore").encode()
                out.append((len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), kept))
            else:
                out.append((len(text), 0, 0, text))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], b.column("_doc")],
            ["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept", "_doc"],
        )


def _by_shard(df: DataFrame, tasks: int) -> GroupedData:
    """Groups of one shard each, dealt to a given number of tasks.

    AQE would merge tasks by their few shuffled bytes until each core has one or two
    of them; the time goes into the work on these bytes, and one late task holds up all.
    """
    return df.repartition(tasks, "shard").groupBy("shard")


def repeated_marks(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, marks (first window << 8 | number of windows) and copies (see ``_doc_rows``) of the rows with repeated strings."""
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-n_bytes // SHARD_BYTES))
    packed = rows.mapInArrow(lambda x: _entries(x, shards), "shard int, docs binary, entries binary, k int")
    lists = "marks array<long>, wanted array<long>, groups array<long>, copies array<long>"
    settled = _by_shard(packed, shards).applyInArrow(_settle, f"doc_id long, text_hash long, {lists}")
    settled = stored(settled, "settled")
    wanted = settled.where(F.size("wanted") > 0).groupBy("doc_id", "text_hash").agg(
        F.flatten(F.collect_list("wanted")).alias("wanted"), F.flatten(F.collect_list("groups")).alias("groups")
    )
    wanted = stored(wanted, "wanted")
    count = wanted.agg(F.sum(F.size("wanted")), F.count(F.lit(1))).first()
    n_pieces, size = count[0] or 0, (count[0] or 0) * 16 + count[1] * 64
    indexes = max(LEAST_SHARDS, -(-n_pieces * (WIDTH + GRAM) // INDEX_BYTES))
    pieces = beside_rows(rows, wanted, size).where("wanted IS NOT NULL")
    pieces = pieces.mapInArrow(lambda x: _pieces(x, indexes), "shard int, doc_id long, text_hash long, lo long, piece binary")
    matched = _by_shard(pieces, max(LEAST_SHARDS, indexes // TASK_INDEXES)).applyInArrow(_match, "doc_id long, text_hash long, marks array<long>")
    matched = matched.withColumn("copies", F.expr("cast(array() as array<long>)"))
    marks = settled.where(F.size("marks") + F.size("copies") > 0).select("doc_id", "text_hash", "marks", "copies").unionByName(matched)
    return marks.groupBy("doc_id", "text_hash").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("marks", "copies")])


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, whole_chars: bool = False) -> DataFrame:
    """doc_id, text_hash, n_bytes, n_removed, n_spans, kept (the remaining bytes) and _doc (``keep`` columns) of every text.

    With ``whole_chars`` the bytes left of a character cut in two go, too.
    """
    rows = row_key(docs)
    marks = stored(repeated_marks(rows).where(F.size("marks") > 0), "marks")
    size = marks.agg(F.sum(F.size("marks") + F.size("copies")) * 8 + F.count(F.lit(1)) * 64).first()[0] or 0
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = F.struct(F.lit(None).cast("int").alias("_none"), *[F.col(f"`{c}`") for c in keep or []])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), kept.alias("_doc"))
    schema = f"doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept binary, _doc {rows.schema['_doc'].dataType.simpleString()}"
    return beside_rows(rows, marks, size).mapInArrow(lambda x: _cut(x, whole_chars), schema)
