"""N-gram Jaccard join with a count-vector R-tree.

A document is its set of hashed word shingles.  Equal sets are one class.  The
set's shingles are also hashed into ``GROUPS`` groups, and the group counts are
the class's point.  The summed coordinate minima of two points bound the
overlap of their sets from above, and those of a point and a box (the largest
counts below a tree node) bound the overlap with everything in the box.

Points are dealt to cells by the shingles of their prefix: sets that reach the
similarity share one of their smallest n - ceil(t n) + 1 hashes.  Of cells with
equal members (by 128 bits of hash) one is searched.  Every cell
has an R-tree (a cell of up to ``FANOUT`` points is one leaf); a query point
descends where the bound allows a link, and each point proposes its smallest
surviving neighbours of other components (over all cells: one in the first
round, ``MORE`` times as many in each later one).  Proposals meet as bit sets of
``BITS`` bits or more an item, which bound the overlap from above; pairs that these allow are
verified on the full sets, components are merged, and rounds follow until no pair is left that the
bound allows, that is not connected and that was not refuted (or a round has
offered all such pairs).  So no link is
lost, and a group of near copies proposes a few pairs per member, never all.
Components only grow and refuted pairs stay so: a cell that was searched whole
and had no such pair has none later and takes no part in the next rounds.

A cell of over ``CELL`` points is dealt to blocks of about ``CELL``: first each
block is searched by itself; later the members of the commonest component have
blocks of their own, and each block of the others meets itself and every other
block once, a pair of blocks in one part.  A shingle that many sets hold makes
such a cell where it is in their prefixes, so shingles found to make one (a first
pass counts them, somewhat beyond the prefixes) come
last in the order that prefixes are taken from (any order finds all links).

Written steps that no later one reads are deleted on the way.

Null text and text without a word have an empty set and link with nothing; a
text of fewer words than a shingle is one shingle; rows with equal sets share
their component; null ids never name a component unless nothing else can;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.components import components
from tradelens.llm.flat import (
    beside_rows,
    doc_slices,
    flat_text,
    lower_ascii,
    mix64,
    prefix_sums,
    row_key,
    span_hash,
    word_hashes,
    word_spans,
)
from tradelens.llm.stored import discard, small_batches, stored

SHINGLE, PERCENT = 4, 85
GROUPS, FANOUT, CELL, HUB, MORE = 256, 16, 2000, 500, 4
#: Orders of shingles tried at most, and commonest shingles put last by each (8 bytes each, shipped to tasks).
ORDERS, COMMON = 2, 1 << 16
#: Bytes of text handled at once (a longer text is one slice): small slices stay in the cache and bound a worker's arrays.
SLICE = 1 << 17
#: Smallest cells of a class that travel with it, by which a pair is proposed in one of its common cells.
FIRSTS = 6
#: Members of cells whose proposals are made at once (whole parts; the largest, a pair of blocks, has about two cells' worth).
FLUSH = 8_000
#: Least bits of a bit set for each item, and bytes of sets in one batch (a larger set is one batch).
BITS, SETS_BYTES = 8, 8 << 20
#: Measured bytes of verdicts and visits (a few per near copy) that may be broadcast.
BROADCAST_LISTS = 16 << 20


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within a row, and each row's first place."""
    buf = lower_ascii(buf)
    starts, ends, first = word_spans(buf, offsets)
    sums = prefix_sums(word_hashes(buf, starts, ends))
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    h = span_hash(sums, at, at + np.minimum(width, n[row]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def _narrow(most: int) -> str:
    """The narrowest type for counts up to ``most``."""
    return "u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"


def _prefix(h: np.ndarray, first: np.ndarray, percent: int, common: np.ndarray, spare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of all sets (half as long again if ``spare``) and their lengths; ``common`` shingles come last in the order."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    take = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
    if spare:
        take = np.minimum(take + take // 2, n)
    ranked = h[np.lexsort((h, np.isin(h, common), row))] if len(common) else h
    return ranked[np.arange(len(h)) - first[row] < take[row]].view(np.int64), take


def _cell_counts(batches: Iterator[pa.RecordBatch], width: int, percent: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offsets = flat_text(b.column("text"))
        for lo, hi in doc_slices(offsets, SLICE):
            h, first = shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
            cell, c = np.unique(_prefix(h, first, percent, common, spare=True)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(c, pa.int32())], ["cell", "c"])


def _common_shingles(rows: DataFrame, width: int, percent: int) -> np.ndarray:
    """Shingles in the prefixes of over ``CELL`` rows, the commonest ``COMMON`` of each order."""
    common = np.zeros(0, np.uint64)
    for _ in range(ORDERS - 1):
        counts = rows.mapInArrow(lambda x, common=common: _cell_counts(x, width, percent, common), "cell long, c int").groupBy("cell").agg(F.sum("c").alias("c"))
        with small_batches(rows.sparkSession):
            large = counts.where(F.col("c") > CELL).orderBy(F.desc("c"), "cell").limit(COMMON).toArrow()
        new = np.setdiff1d(large["cell"].to_numpy().view(np.uint64), common)
        if not len(new):
            break
        common = np.union1d(common, new)
    return common


def _row_ids(b: pa.RecordBatch, lo: int, hi: int) -> list[pa.Array]:
    return [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_hash")]


def _points(batches: Iterator[pa.RecordBatch], width: int, percent: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with their points and prefixes; ``common`` shingles come last in a prefix's order."""
    for b in batches:
        buf, offsets = flat_text(b.column("text"))
        for lo, hi in doc_slices(offsets, SLICE):
            h, first = shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            total = np.r_[np.uint64(0), np.cumsum(mix64(h ^ np.uint64(0x5851F42D4C957F2D)))]
            name = mix64(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64)
            cells, take = _prefix(h, first, percent, common)
            counts = np.bincount(row * GROUPS + (mix64(h) % np.uint64(GROUPS)).astype(np.int64), minlength=len(n) * GROUPS)
            points = counts.astype("<u4").reshape(-1, GROUPS)
            yield pa.RecordBatch.from_arrays(
                [
                    *_row_ids(b, lo, hi),
                    pa.array(n, pa.int64()),
                    pa.array(name),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)], pa.int32()), pa.array(cells)),
                    pa.array([p.astype(_narrow(m)).tobytes() for p, m in zip(points, points.max(axis=1).tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "text_hash", "n", "class", "cells", "point"],
            )


def _bit_sets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit sets of all rows' items, a power of two and at least ``BITS`` bits an item, as bytes, and each row's first byte."""
    n = np.diff(first)
    bits = 1 << np.ceil(np.log2(np.maximum(n * BITS, 64))).astype(np.int64)
    start = np.r_[0, np.cumsum(bits)]
    row = np.repeat(np.arange(len(n)), n)
    hit = np.zeros(start[-1], bool)
    hit[start[row] + (h & (bits[row] - 1).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(hit, bitorder="little"), start // 8


def most_shared(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """At least the number of items that two sets share, from their bit sets and sizes.

    Shared items hit shared bits; those that fall together do so in either set.
    A larger bit set is folded to the smaller one's size.
    """
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    ones = lambda x: int(np.bitwise_count(x).sum(dtype=np.int64))
    return min(ones(a & b) + min(n_a - ones(a), n_b - ones(b)), n_a, n_b)


def _visits(batches: Iterator[pa.RecordBatch], width: int, as_bits: bool) -> Iterator[pa.RecordBatch]:
    """The set of each row (8 bytes an item) or its bit set, once per visit."""
    for b in batches:
        buf, offsets = flat_text(b.column("text"))
        for lo, hi in doc_slices(offsets, SLICE):
            h, first = shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
            data, at = _bit_sets(h, first) if as_bits else (h.view(np.uint8), first * 8)
            sets = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
            visits = b.column("visits").slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), np.diff(np.array(visits.offsets)))
            flat, names, n = visits.flatten(), b.column("class").slice(lo, hi - lo), np.diff(first)
            batch = np.cumsum(np.diff(at)[row]) // SETS_BYTES
            for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(batch)) + 1):
                if len(part):
                    k = pa.array(row[part])
                    own = flat.slice(int(part[0]), len(part))
                    yield pa.RecordBatch.from_arrays(
                        [own.field("part"), own.field("hub"), names.take(k), pa.array(n[row[part]]), sets.take(k).cast(pa.binary())],
                        ["part", "hub", "class", "n", "items"],
                    )


def _compare(batches: Iterator[pa.RecordBatch], percent: int, as_bits: bool) -> Iterator[pa.RecordBatch]:
    """Sets sorted by part, the hub's first -> verdicts on (hub, class): exact, or whether bit sets allow the similarity."""
    hub, own, size = None, np.zeros(0, np.uint8), 0
    for b in batches:
        hubs, names, sizes, items = b.column("hub").to_pylist(), b.column("class").to_pylist(), b.column("n").to_pylist(), b.column("items")
        out = []
        for k, (h, name, n) in enumerate(zip(hubs, names, sizes, strict=True)):
            values = np.frombuffer(items[k].as_buffer(), np.uint8 if as_bits else np.uint64)
            if h == name:
                hub, own, size = h, values.copy(), n
            elif h == hub:
                shared = most_shared(own, size, values, n) if as_bits else len(np.intersect1d(own, values, assume_unique=True))
                out.append((h, name, 100 * shared >= percent * (size + n - shared)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "linked"])


class CountTree:
    """R-trees over the points of many cells: each level boxes runs of ``FANOUT`` nodes of a cell.

    Points are sorted by cell and size.  A node keeps the largest count of
    every group and the smallest and largest size below it.  ``target`` is the
    cell that a point searches: its own, an earlier one, or -1 for none.
    """

    def __init__(self, cell: np.ndarray, target: np.ndarray, size: np.ndarray, points: np.ndarray, percent: int) -> None:
        self.percent = percent
        self.size, self.points = size, points
        self.levels = []  # (child of node, box, least size, largest size), leaves first
        owner, box, low, high = cell, points, size, size
        while True:
            new = np.r_[True, owner[1:] != owner[:-1]]
            start = np.flatnonzero(new)
            place = np.arange(len(owner)) - start[np.cumsum(new) - 1]
            begins = np.flatnonzero(place % FANOUT == 0)
            self.levels.append((np.r_[begins, len(owner)], np.maximum.reduceat(box, begins), np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins)))
            owner = owner[begins]
            _, box, low, high = self.levels[-1]
            if len(np.unique(owner)) == len(owner):
                break
        self.queries = np.flatnonzero(np.isin(target, owner))
        self.root = np.searchsorted(owner, target[self.queries])
        self.own = target == cell

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a point and one of its target cell whose bound reaches the similarity, each once."""
        step = 500
        for a in range(0, len(self.queries), step):
            query, node = self.queries[a : a + step], self.root[a : a + step]
            for children, box, low, high in reversed(self.levels):
                ok = self._reach(query, node, box, low, high)
                query, node = query[ok], node[ok]
                n = children[node + 1] - children[node]
                query = np.repeat(query, n)
                node = np.repeat(children[node] - np.cumsum(n) + n, n) + np.arange(len(query))
            once = (node > query) | ~self.own[query]
            query, node = query[once], node[once]
            ok = self._reach(query, node, self.points, self.size, self.size)
            yield query[ok], node[ok]

    def _reach(self, query: np.ndarray, node: np.ndarray, box: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether sizes and summed minima allow a link of a point with something in a box."""
        p, n = self.percent, self.size[query]
        low, high = low[node], high[node]
        ok = (100 * high >= p * n) & (100 * n >= p * low)
        least = p * (n + np.maximum(low, (p * n + 99) // 100))
        for k in np.array_split(np.flatnonzero(ok), max(1, int(ok.sum()) // 5_000)):
            ok[k] = (100 + p) * np.minimum(self.points[query[k]], box[node[k]]).sum(axis=1, dtype=np.int64) >= least[k]
        return ok


def met_before(cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs with smallest cells ``a`` and ``b`` (padded with the cell itself or more) share one below ``cell``."""
    out = np.zeros(len(cell), bool)
    for x in range(a.shape[1]):
        low = a[:, x] < cell
        for y in range(b.shape[1]):
            out |= low & (a[:, x] == b[:, y])
    return out


def _propose(batches: Iterator[pa.RecordBatch], percent: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted members of whole cells (by part) -> pairs of classes to verify.

    Rows (null, null, cell) name the cells with pairs; a row of nulls says that pairs were held back.
    """

    def flush(t: pa.Table) -> pa.RecordBatch:
        part = np.searchsorted(np.unique(t["part"].to_numpy()), t["part"].to_numpy())
        size, name, comp, cell = (t[c].to_numpy() for c in ("n", "class", "comp", "cell"))
        raw = [x.as_buffer() for x in t["point"]]
        widest = max(len(x) for x in raw) // GROUPS
        points = np.empty((len(raw), GROUPS), np.uint16 if widest < 4 else np.uint32)
        for k, x in enumerate(raw):
            points[k] = np.frombuffer(x, f"<u{len(x) // GROUPS}")
        side = t["side"].to_numpy()  # 0 is searched by 1, 2 by itself
        order = np.lexsort((name, size, side, part))
        part, side, size, name, comp, cell, points = part[order], side[order], size[order], name[order], comp[order], cell[order], points[order]
        firsts = np.full((len(raw), FIRSTS), np.iinfo(np.int64).max)
        for k, x in enumerate(t["firsts"].to_pylist()):
            firsts[k, : len(x or ())] = x or ()
        firsts = firsts[order]
        refuted = {int(name[k]): set(x) for k, x in enumerate(t["refuted"].take(pa.array(order)).to_pylist()) if x}
        left, right = [], []
        target = np.where(side == 0, -1, np.where(side == 1, 3 * part, 3 * part + 2))
        for i, j in CountTree(3 * part + side, target, size, points, percent).pairs():
            other = (comp[i] != comp[j]) & (name[i] != name[j])
            i, j = i[other], j[other]
            # A smaller cell that both are known to be in proposes the pair (or holds it back).
            new = ~met_before(cell[i], firsts[i], firsts[j])
            left.append(i[new])
            right.append(j[new])
        i, j = np.concatenate(left), np.concatenate(right)
        a, b, at, cell = np.minimum(name[i], name[j]), np.maximum(name[i], name[j]), part[i], cell[i]
        if refuted and len(a):
            ok = np.array([y not in refuted.get(x, ()) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            a, b, at, cell = a[ok], b[ok], at[ok], cell[ok]
        cell = np.unique(cell)
        order = np.lexsort((a, b, at))  # each larger name proposes its `most` smallest partners in a cell
        a, b, at = a[order], b[order], at[order]
        new = np.r_[True, (b[1:] != b[:-1]) | (at[1:] != at[:-1])] if len(a) else np.zeros(0, bool)
        place = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(a) else np.zeros(0, np.int64)
        ab = np.unique(np.stack([a[place < most], b[place < most]], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        held_back = [None] if (place >= most).any() else []
        others = pa.nulls(len(cell) + len(held_back), pa.int64())
        cols = (
            (pa.array(ab[:, 0]), others),
            (pa.array(ab[:, 1]), others),
            (pa.nulls(len(ab), pa.int64()), pa.array([*cell.tolist(), *held_back], pa.int64())),
        )
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], ["a", "b", "cell"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= FLUSH:  # all parts but the last are complete
            t = pa.Table.from_batches(held).combine_chunks()
            part = t["part"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, part != part[-1]])[-1])
            if cut:
                yield flush(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = len(t) - cut
    if rows:
        yield flush(pa.Table.from_batches(held).combine_chunks())


def _parts(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """part, side, cell, class, comp: members of the cells that have several components, dealt to parts of bounded size.

    A part is a small cell or a block, searched by itself (side 2), or a pair
    of blocks of a split cell, of which one (1) searches the other (0).
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / CELL)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    if roots is None:
        rows = members.withColumn("comp", F.col("class")).withColumn("_b", blocks("m")).withColumn("_x", own("_b"))
        rows = rows.withColumn("_y", F.col("_x")).withColumn("side", F.lit(2))
    else:
        rows = members.join(roots, "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root")
        per = rows.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("k"))
        per = per.groupBy("cell").agg(F.max_by(F.struct("comp", "k"), F.struct("k", "comp")).alias("e"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("comps"))
        per = per.where("comps > 1").select("cell", F.col("e.comp").alias("major"), F.col("m").alias("_m"), (F.col("m") - F.col("e.k")).alias("_o"), F.col("e.k").alias("_k"))
        per = per.withColumn("_bo", F.when(F.col("_m") <= CELL, 1).otherwise(blocks("_o"))).withColumn("_bk", F.when(F.col("_m") <= CELL, 0).otherwise(blocks("_k")))
        # Blocks 0 to _bo - 1 are the others', the rest the commonest component's; whole cells have block 0 only.
        rows = rows.join(per, "cell").withColumn("_large", (F.col("comp") == F.col("major")) & (F.col("_bk") > 0))
        rows = rows.withColumn("_x", F.when(F.col("_large"), F.col("_bo") + F.pmod(F.xxhash64("class"), F.greatest("_bk", F.lit(1)))).otherwise(own("_bo")).cast("int"))
        last = F.when(F.col("_large"), F.col("_bo") - 1).otherwise(F.col("_bo") + F.col("_bk") - 1)
        rows = rows.withColumn("_y", F.explode(F.sequence(F.lit(0), last)))
        rows = rows.withColumn("side", F.when(F.col("_x") == F.col("_y"), 2).when(F.col("_x") < F.col("_y"), 0).otherwise(1))
    return rows.select(F.xxhash64("cell", F.least("_x", "_y"), F.greatest("_x", "_y")).alias("part"), "side", "cell", "class", "comp")


def join_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (smallest doc_id of linked documents), group of every row."""
    rows = row_key(docs)
    schema = "doc_id long, text_hash long, n long, class long, cells array<long>, point binary"
    common = _common_shingles(rows, width, percent)
    points = stored(rows.mapInArrow(lambda x: _points(x, width, percent, common), schema), "points")
    classes = points.where("n > 0").groupBy("class").agg(
        F.min("doc_id").alias("low"), F.min_by(F.struct("doc_id", "text_hash"), F.struct("doc_id", "text_hash")).alias("one"), F.first("n").alias("n"),
        F.first("cells").alias("cells"), F.first("point").alias("point"),
    )
    classes = stored(classes, "classes")
    seen = stored(points.select("doc_id", "text_hash", "n", "class"), "names")
    discard(points)
    full = seen.where("n > 0")
    cells = classes.select(F.explode("cells").alias("cell"), "class")
    # A class is once in a cell, so exclusive ors name the members; most cells of a pair of near copies hold just them.
    names = [F.bit_xor("class").alias("x"), F.bit_xor(F.xxhash64("class")).alias("y")]
    many = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), *names).where("m > 1")
    many = many.groupBy("m", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "m")
    members = stored(cells.join(many, "cell"), "members")
    links = refuted = roots = None
    turn, done = 0, False
    while not done:
        points = classes.select("class", "n", "point")
        if refuted is None:
            points = points.withColumn("refuted", F.lit(None).cast("array<long>"))
        else:
            points = points.join(refuted.groupBy(F.col("a").alias("class")).agg(F.collect_set("b").alias("refuted")), "class", "left")
        # Cells split in the first round do not show all their pairs then, so they stand for none there.
        whole = members.where(F.col("m") <= CELL) if turn == 0 else members
        firsts = whole.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("cell")), 1, FIRSTS).alias("firsts"))
        points = points.join(firsts, "class", "left")
        # Names are dealt first; points join them once, on their way to the parts.
        dealt = _parts(members, roots).join(points, "class").repartition("part").sortWithinPartitions("part")
        most = MORE ** min(turn, 10)
        found = dealt.mapInArrow(lambda x, most=most: _propose(x, percent, most), "a long, b long, cell long")
        found = stored(found.distinct(), "proposed")
        proposed = found.where("a IS NOT NULL").select("a", "b")
        # A class offers its smallest partners over all cells.
        place = F.row_number().over(Window.partitionBy("b").orderBy("a"))
        offered = stored(proposed.withColumn("k", place).where(F.col("k") <= most).select("a", "b"), "offered")
        n_proposed, n_held = found.agg(F.count("a"), F.count_if(F.coalesce("a", "cell").isNull())).first()
        n_offered = offered.count()
        # The first round searches split cells by their parts only; later ones search all.
        done = turn > 0 and n_held == 0 and n_offered == n_proposed
        if turn and not n_offered:
            discard(found, offered)
            break
        if not done:
            busy = found.where("a IS NULL AND cell IS NOT NULL").select("cell", F.lit(True).alias("busy"))
            searched = members
            members = members.join(busy, "cell", "left").where(F.col("busy") | F.lit(turn == 0) & (F.col("m") > CELL)).drop("busy")
            members = stored(members, "members")
            discard(searched)
        checked = _verified(rows, classes, offered, width, percent)
        discard(found, offered)
        new = checked.where("linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        no = checked.where(~F.col("linked")).select("a", "b")
        refuted = no if refuted is None else refuted.unionByName(no)
        before, roots = roots, stored(components(links).withColumnRenamed("node", "class"), "roots")
        if before is not None:
            discard(before)
        turn += 1
    discard(members)
    points = classes.select("class").join(roots, "class", "left").select("class", F.coalesce("root", "class").alias("comp"))
    named = classes.select("class", "low").join(points, "class")
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "comp").select("class", "component_id", F.col("comp").alias("group"))
    out = full.select("doc_id", "text_hash", "n", "class").join(named, "class")
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "group")
    alone = seen.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone.withColumn("group", F.lit(None).cast("long")))


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without those linked to an earlier one: the smallest id of each component stays.

    Of equal ids the smallest text hash stays, of equal rows one; documents
    without a word stay.  Only the verdicts on dropped rows travel: broadcast
    up to a measured size, else joined.
    """
    linked = stored(join_components(docs, width, percent).where("group IS NOT NULL"), "linked")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = linked.groupBy("group").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("k")).where("k > 1")
    verdict = linked.join(best, "group").withColumn("first", F.col("best") == order).groupBy("doc_id", "text_hash", "first").agg(F.count(F.lit(1)).alias("k"))
    verdict = stored(verdict.where("NOT first OR k > 1").select("doc_id", "text_hash", F.col("first").alias("_first")), "verdict")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"))
    judged = beside_rows(rows, verdict, verdict.count() * 64, BROADCAST_LISTS)
    once = judged.where("_first").dropDuplicates(["doc_id", "text_hash"])
    return judged.where("_first IS NULL").unionByName(once).select("_doc.*")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, linked: verdicts on pairs of classes (stored), by bit sets first and exactly where these allow a link."""
    allowed = _met(rows, classes, pairs, width, percent, as_bits=True)
    left = allowed.where("linked").select("a", "b")
    if left.isEmpty():
        return allowed
    exact = _met(rows, classes, left, width, percent, as_bits=False)
    checked = stored(exact.unionByName(allowed.where("NOT linked")), "checked")
    discard(allowed, exact)
    return checked


def _met(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, as_bits: bool) -> DataFrame:
    """a, b, linked of pairs of classes (stored), whose sets are rebuilt from one text of each class.

    The smaller class of a pair is the hub that the other's set visits; a hub
    of many is copied, one copy per ``HUB`` visitors.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("copies"))
    part = lambda salt: F.xxhash64("hub", salt.cast("int"))
    come = pairs.join(hubs, "a").select(F.col("a").alias("hub"), F.col("b").alias("class"), F.pmod(F.xxhash64("b"), F.col("copies")).alias("salt"))
    own = hubs.select(F.col("a").alias("hub"), F.col("a").alias("class"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    visits = come.select("hub", "class", F.col("salt").cast("int").alias("salt")).unionByName(own)
    lists = visits.groupBy("class").agg(F.collect_list(F.struct(part(F.col("salt")).alias("part"), "hub")).alias("visits"))
    lists = lists.join(classes.select("class", "one"), "class").select(F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash"), "class", "visits")
    lists = stored(lists, "visits")
    size = lists.agg(F.sum(F.size("visits") * 16 + 64)).first()[0] or 0
    found = beside_rows(rows, lists, size, BROADCAST_LISTS).where("visits IS NOT NULL")
    sets = found.mapInArrow(lambda x: _visits(x, width, as_bits), "part long, hub long, class long, n long, items binary")
    sets = sets.repartition("part").sortWithinPartitions("part", F.col("hub") != F.col("class"), "hub")
    out = stored(sets.mapInArrow(lambda x: _compare(x, percent, as_bits), "a long, b long, linked boolean").distinct(), "met")
    discard(lists)
    return out


