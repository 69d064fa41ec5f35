"""Hard-negative mining by cover trees over norm-augmented candidates.

Vectors are quantised to integers, so scores (inner products) are exact.  Rows
with the same vector and label are one point; of its ids the smallest few are
kept, which are all that a list of the first few can name.  Points are dealt by
hash to blocks of about ``BLOCK``, anchors to groups of ``ANCHORS``, and each
anchor group meets each block in a task of its own.

There a cover tree is built: candidates are augmented by one coordinate so that
all have the largest norm M, which makes inner products with an anchor a
function of the angle to it.  Each level shrinks the covering radius by
``BASE``; a node keeps the largest distance to anything below it.  The angle
between anchor and centre, plus and minus the radius' angle, bounds all scores
below the node.  A best-first descent opens the node with the highest bound,
skips nodes outside the window of wanted scores or below the worst kept score,
and verifies leaves by exact products.

First every anchor's positives are found (same label, best first), then for each
positive the best rows of other labels with a score in its window.  Per block
only the first few survive, so the lists that Spark ranks at the end are short.

Rows with a null id, label or vector, or a null or non-finite component, take
no part.  Shorter vectors count as filled up with zeros.  Ties go to the smaller
id; repeated rows (same id, label and vector) count once; "other rows" are those
with another id.  Empty tables give empty results; other columns are ignored.
Scores must fit a long: larger components raise an error, as sums do under ANSI.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.stored import stored

#: Points of a block and anchors of a group: what a task holds at once.
BLOCK, ANCHORS = 4096, 1024
#: Ratio of covering radii of two levels, and the size up to which a node is a leaf.
BASE, LEAF = 1.3, 24
#: Bounds below which floats of each width hold every integer.
SINGLE, DOUBLE = float(1 << 24), float(1 << 53)
#: Rounding of distances, as a part of the largest norm; every covering radius is widened by it.
BLUR = 1e-7


class CoverTree:
    """Cover tree over the rows of an integer matrix, with windowed inner-product search."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.points = points
        self.peak = float(np.abs(points).max(initial=0))
        plain = points.astype(np.float64)
        norms = (plain**2).sum(axis=1)
        self.radius = math.sqrt(norms.max(initial=0.0))
        self.vectors = np.c_[plain, np.sqrt(np.maximum(self.radius**2 - norms, 0))]
        self.order = np.zeros(n, np.int64)
        self.centre: list[int] = []
        self.reach: list[float] = []
        self.children: list[list[int]] = []
        self.bucket: list[tuple[int, int]] = []
        self._filled = 0
        if n:
            self._build(np.arange(n), self._distance(np.arange(n), 0))
        self.angle = 2 * np.arcsin(np.clip(np.array(self.reach) / (2 * self.radius or 1), 0, 1))
        del self.vectors
        self.double = plain
        self.single = plain.astype(np.float32) if self.peak < SINGLE else None

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        """Distances on the sphere of radius M, up to ``BLUR`` times M."""
        return np.sqrt(np.maximum(2 * (self.radius**2 - self.vectors[rows] @ self.vectors[centre]), 0))

    def _node(self, centre: int, reach: float) -> int:
        self.centre.append(centre)
        self.reach.append(reach + BLUR * self.radius)
        self.children.append([])
        self.bucket.append((0, 0))
        return len(self.centre) - 1

    def _fill(self, rows: np.ndarray) -> tuple[int, int]:
        start = self._filled
        self._filled += len(rows)
        self.order[start : self._filled] = rows
        return start, self._filled

    def _build(self, rows: np.ndarray, far: np.ndarray) -> None:
        """Nodes from the root down; the first row of each set is its centre."""
        work = [(self._node(int(rows[0]), float(far.max())), rows, far)]
        while work:
            node, rows, far = work.pop()
            reach = float(far.max())
            if len(rows) <= LEAF or reach <= BLUR * self.radius:
                self.bucket[node] = self._fill(rows)
                continue
            # Farthest rows become centres until all lie within the next level's radius:
            # covered by it, centres farther apart than it, the old centre among them.
            near, owner, centres = far.copy(), np.zeros(len(rows), np.int64), [0]
            near[0] = 0
            while near.max() > reach / BASE:
                c = int(near.argmax())
                d = self._distance(rows, int(rows[c]))
                d[c] = 0
                closer = d < near
                near[closer], owner[closer] = d[closer], len(centres)
                centres.append(c)
            order = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[order], np.arange(len(centres) + 1))
            alone = []
            for k, c in enumerate(centres):
                mine = order[edges[k] : edges[k + 1]]
                if len(mine) == 1:
                    alone.append(rows[c])
                    continue
                mine = np.r_[c, mine[mine != c]]
                child = self._node(int(rows[c]), float(near[mine].max()))
                self.children[node].append(child)
                work.append((child, rows[mine], near[mine]))
            if alone:  # centres that cover nothing else are verified together
                self.bucket[node] = self._fill(np.array(alone))

    def products(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: in floats as far as they hold every integer, else in longs."""
        limit = self.peak * float(np.abs(query).max(initial=0)) * max(self.points.shape[1], 1)
        if limit >= 2.0**63:
            raise ArithmeticError("inner products exceed a long")
        if limit < SINGLE and self.single is not None:
            return self.single[rows] @ query.astype(np.float32)
        return self.double[rows] @ query.astype(np.float64) if limit < DOUBLE else self.points[rows] @ query

    def search(
        self,
        query: np.ndarray,
        wanted: np.ndarray,
        ids: list[list[int]],
        k: int,
        windows: list[tuple[float, float]],
        but: int | None = None,
    ) -> tuple[list[list[tuple[int, int]]], int]:
        """Per window the first k (score, id) with low <= score <= high, and the points verified.

        ``wanted`` marks points (by their row in the matrix), ``ids`` holds each
        point's ids ascending; ``but`` is an id to leave out, no wanted point's
        only one.  The best nodes are opened in rounds of 1, 2, 4 and so on, so few rounds meet many nodes.
        """
        best: list[list[tuple[int, int]]] = [[] for _ in windows]  # (score, -id), the worst kept one first
        if not len(self.order):
            return best, 0
        scale = math.sqrt(float((query.astype(np.float64) ** 2).sum())) * self.radius
        slack = 1e-9 * scale + 1e-6
        at = np.arccos(np.clip(self.products(np.array(self.centre), query) / (scale or 1.0), -1, 1))
        tops = (scale * np.cos(np.maximum(at - self.angle, 0)) + slack).tolist()
        bottoms = (scale * np.cos(np.minimum(at + self.angle, np.pi)) - slack).tolist()
        least = [low for low, _ in windows]

        def of_use(node: int) -> bool:
            return any(tops[node] >= x and bottoms[node] <= high for x, (_, high) in zip(least, windows, strict=True))

        verified, width = 0, 1
        heap = [(-tops[0], 0)]
        while heap:
            rows = []
            for _ in range(min(width, len(heap))):
                _, node = heapq.heappop(heap)
                if not of_use(node):
                    continue
                a, b = self.bucket[node]
                if b > a:
                    rows.append(self.order[a:b])
                for child in self.children[node]:
                    if of_use(child):
                        heapq.heappush(heap, (-tops[child], child))
            width *= 2
            if not rows:
                continue
            some = np.concatenate(rows)
            some = some[wanted[some]]
            scores = self.products(some, query)
            verified += len(some)
            for w, (low, high) in enumerate(windows):
                kept = best[w]
                hit = np.flatnonzero((scores >= least[w]) & (scores <= high))
                if len(hit) > k:  # ties with the k-th stay
                    hit = hit[scores[hit] >= np.partition(scores[hit], len(hit) - k)[len(hit) - k]]
                for row, score in zip(some[hit].tolist(), scores[hit].tolist(), strict=True):
                    for i in ids[row]:
                        if i == but:
                            continue
                        item = (int(score), -i)
                        if len(kept) < k:
                            heapq.heappush(kept, item)
                        elif item > kept[0]:
                            heapq.heapreplace(kept, item)
                        else:
                            break
                if len(kept) == k:
                    least[w] = max(low, kept[0][0])
        return [[(s, -i) for s, i in sorted(kept, reverse=True)] for kept in best], verified


def quantised(rows: DataFrame, *, scale: int = 256, label: F.Column | None = None) -> DataFrame:
    """vec_id, label, vector (array of long: floor(scale * component)) of the rows that take part."""
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    vector = F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))")
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), vector.alias("vector")
    )


def _matrix(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as a matrix; short rows are filled up with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def _search_blocks(points: DataFrame, anchors: DataFrame, n_blocks: int, n_groups: int, width: int, k: int, windows: tuple[int, int] | None) -> DataFrame:
    """The first k partners of every anchor (or of each of its windows) in every block.

    Every group of anchors meets every block of points once, in one task.
    """
    each_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    each_group = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("grp")
    left = points.select("*", each_group)
    right = anchors.select("*", each_block)
    schema = "anchor long, anchor_id long, place long, positive_id long, positive_score long, other_id long, score long"

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple[int | None, ...]] = []
        if ours.num_rows and theirs.num_rows:
            tree = CoverTree(_matrix(ours.column("vector"), width))
            labels = ours.column("label").to_numpy()
            ids = ours.column("ids").to_pylist()
            lowest, lone = np.array([x[0] for x in ids]), np.array([len(x) == 1 for x in ids])
            queries = _matrix(theirs.column("vector"), width)
            positives = theirs.column("positives").to_pylist() if windows else None
            names = zip(theirs.column("anchor").to_pylist(), theirs.column("anchor_id").to_pylist(), theirs.column("label").to_pylist(), strict=True)
            for j, (anchor, anchor_id, label) in enumerate(names):
                if windows is None:
                    wanted = (labels == label) & ~(lone & (lowest == anchor_id))
                    found, _ = tree.search(queries[j], wanted, ids, k, [(-math.inf, math.inf)], anchor_id)
                    out += [(anchor, anchor_id, None, None, None, i, s) for s, i in found[0]]
                    continue
                asked = [(-(-windows[0] * p["score"] // 100), windows[1] * p["score"] // 100) for p in positives[j]]
                lists, _ = tree.search(queries[j], labels != label, ids, k, asked)
                for place, (p, found) in enumerate(zip(positives[j], lists, strict=True)):
                    out += [(anchor, anchor_id, place, p["id"], p["score"], i, s) for s, i in found]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "other_id", "score"]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    return left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(run, schema)


def mine(rows: DataFrame, is_anchor: F.Column, *, n_positives: int = 5, n_negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` come from ``quantised``; ``is_anchor`` is a condition on them.
    Negatives of a positive score from ``window[0]`` to ``window[1]`` percent of it.
    """
    spark = rows.sparkSession
    rows = stored(rows.distinct(), "vectors")
    anchors = rows.where(is_anchor).select(
        F.xxhash64("vec_id", "label", "vector").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector"
    )
    keep = max(n_positives + 1, n_negatives)
    # The smallest ids of a point, cut before the shuffle: a frequent vector does not fill a task.
    first = Window.partitionBy("vector", "label").orderBy("vec_id")
    ranked = rows.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= keep)
    points = ranked.groupBy("vector", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points, anchors = stored(points, "points"), stored(anchors, "anchors")
    n_points, width = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    n_blocks = max(1, -(-n_points // BLOCK))
    n_groups = max(1, -(-anchors.count() // ANCHORS))
    points = points.withColumn("block", F.pmod(F.xxhash64("vector", "label"), F.lit(n_blocks)).cast("int"))
    anchors = anchors.withColumn("grp", F.pmod(F.col("anchor"), F.lit(n_groups)).cast("int"))

    found = _search_blocks(points, anchors, n_blocks, n_groups, width, n_positives, None)
    best = Window.partitionBy("anchor", "anchor_id").orderBy(F.col("score").desc(), "other_id")
    found = found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= n_positives)
    positives = stored(
        found.groupBy("anchor", "anchor_id").agg(F.collect_list(F.struct(F.col("other_id").alias("id"), "score")).alias("positives")), "positives"
    )
    asked = anchors.join(positives, ["anchor", "anchor_id"])
    found = _search_blocks(points, asked, n_blocks, n_groups, width, n_negatives, window)
    best = Window.partitionBy("anchor", "anchor_id", "place").orderBy(F.col("score").desc(), "other_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n_negatives)
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("other_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
