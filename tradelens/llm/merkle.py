"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

Sections are separated by blank lines, paragraphs by line breaks, and a
paragraph's leaves are its sentences (at most ``PIECE`` characters each; runs
of words in a short paragraph), so the tree holds every character of the text.  A node's hash covers its
children's hashes; equal roots mean equal texts, and only branches that differ
need to be followed to find an edit.

A fingerprint is the root (64 hex digits) and the tree below it:
``root:section(paragraph[leaf.leaf],paragraph[leaf]);section(...)``, with
shortened hashes.  The likeness of two trees is twice the number of leaves
they share over the number both have (distinct leaves; two trees without any
difference have 1).

Only DataFrame work.  Null text counts as empty; empty texts have a
fingerprint, too; tables without rows give none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.stored import stored

#: Longest leaf in characters; of a paragraph up to SHORT characters; their patterns.
PIECE, SHORT_PIECE, SHORT = 240, 24, 200
LEAVES = rf"(?s).{{1,{PIECE}}}?(?:[.!?]\s+|\z)|.{{1,{PIECE}}}"
SHORT_LEAVES = rf"(?s).{{1,{SHORT_PIECE}}}(?:\s+|\z)|.{{1,{SHORT_PIECE}}}"
#: Ids of one neighbour bucket; rows of one id from which its bucket is split by id and hash.
BUCKET, HEAVY = 256, 4096
#: Columns of a neighbour cell, in order.
CELL = ("_bucket", "_id", "_part")
#: Ids that may be broadcast when a neighbour lies in another cell (40 bytes each).
BROADCAST_IDS = 1_000_000


def tree(text: str) -> Column:
    """Sections of paragraphs of leaf hashes (hex)."""
    long, short = (f"regexp_extract_all(p, '{x.replace(chr(92), chr(92) * 2)}', 0)" for x in (LEAVES, SHORT_LEAVES))
    return F.expr(
        f"transform(split({text}, '\\n\\n'), s -> transform(split(s, '\\n'), "
        f"p -> transform(CASE WHEN length(p) > {SHORT} THEN {long} ELSE {short} END, x -> sha2(x, 256))))"
    )


def _paragraphs(tree_col: str) -> Column:
    return F.expr(f"transform({tree_col}, s -> transform(s, p -> sha2(concat('p', array_join(p, '')), 256)))")


def with_fingerprint(rows: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds fingerprint, leaves (64-bit each) and paragraphs (hashes) of ``text``."""
    t, p, s = f"_{prefix}tree", f"_{prefix}par", f"_{prefix}sec"
    rows = rows.withColumn(t, tree(text)).withColumn(p, _paragraphs(t))
    rows = rows.withColumn(s, F.expr(f"transform({p}, x -> sha2(concat('s', array_join(x, '')), 256))"))
    body = F.expr(
        f"array_join(transform({s}, (h, i) -> concat(left(h, 12), '(', array_join(transform({p}[i], (g, j) -> "
        f"concat(left(g, 12), '[', array_join(transform({t}[i][j], x -> left(x, 10)), '.'), ']')), ','), ')')), ';')"
    )
    root = F.sha2(F.concat(F.lit("r"), F.array_join(s, "")), 256)
    return (
        rows.withColumn(f"{prefix}fingerprint", F.concat(root, F.lit(":"), body))
        .withColumn(f"{prefix}leaves", F.expr(f"array_distinct(transform(flatten(flatten({t})), x -> xxhash64(x)))"))
        .withColumn(f"{prefix}paragraphs", F.expr(f"transform(flatten({p}), x -> left(x, 12))"))
        .drop(t, p, s)
    )


def likeness(a: str, b: str) -> Column:
    """Share of common leaves, 0 to 1."""
    both = F.size(a) + F.size(b)
    shared = F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))
    return F.coalesce(shared, F.lit(0.0)).cast("double")


def first_difference(a: str, b: str) -> Column:
    """Index of the first paragraph that differs; null if none does."""
    return F.expr(
        f"CASE WHEN {a} = {b} THEN NULL ELSE coalesce(try_element_at(filter(sequence(0, greatest(least(size({a}), size({b})) - 1, 0)), "
        f"i -> get({a}, i) <> get({b}, i)), 1), least(size({a}), size({b}))) END"
    )


def neighbours(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: of the next row by descending doc_id (after the last: the first).

    Rows meet in cells: ``BUCKET`` neighbouring ids, or, where an id (or null)
    has more than ``HEAVY`` rows, one id and the upper bits of its rows' hashes.
    Only the first row of a cell needs one from another; the cells' last ids are
    dealt by range, so each part finds these among its own and the part before.
    A null id sorts as the smallest; equal ids are ordered by a hash of their columns.
    """
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.expr("-9223372036854775807L - 1L"))).withColumn("_tie", F.xxhash64(*columns))
    rows = rows.withColumn("_bucket", F.floor(F.col("_key") / F.lit(BUCKET)).cast("long"))
    heavy = rows.groupBy("_bucket", "_key").count().where(F.col("count") > HEAVY).select("_bucket").distinct()
    heavy = stored(heavy.withColumn("_heavy", F.lit(True)), "heavy-ids")
    rows = rows.join(_small(heavy), "_bucket", "left")
    rows = rows.withColumn("_id", F.when(F.col("_heavy"), F.col("_key")).otherwise(0))
    rows = rows.withColumn("_part", F.when(F.col("_heavy"), F.shiftright("_tie", 52)).otherwise(0).cast("long")).drop("_heavy")
    got = F.struct(*[F.col(c) for c in columns])
    inner = rows.withColumn("_next", F.lag(got).over(Window.partitionBy(*CELL).orderBy("_key", "_tie")))

    tops = rows.groupBy(*CELL).agg(F.max(F.struct("_key", "_tie")).alias("_top"))
    tops = stored(tops.repartitionByRange(*CELL).withColumn("_range", F.spark_partition_id()), "id-tops")
    ranges = tops.groupBy("_range").agg(F.max("_top").alias("_range_top"))
    order = Window.orderBy("_range")  # one row per shuffle partition, whatever the ids are
    last = F.last("_range_top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = ranges.select("_range", F.coalesce(F.lag("_range_top").over(order), last).alias("_before_range"))
    before = tops.withColumn("_before", F.lag("_top").over(Window.partitionBy("_range").orderBy(*CELL))).join(F.broadcast(ranges), "_range")
    before = stored(before.select(*CELL, F.expr("coalesce(_before, _before_range)").alias("_before")).select(*CELL, "_before._key", "_before._tie"), "id-before")
    ends = rows.select("_key", "_tie", *columns).join(_small(before.select("_key", "_tie")), ["_key", "_tie"], "left_semi")
    ends = ends.dropDuplicates(["_key", "_tie"]).select("_key", "_tie", got.alias("_end"))
    ends = ends.join(_small(before), ["_key", "_tie"]).select(*CELL, "_end")
    # The window's partitioning serves this join, too: texts are shuffled once.
    out = inner.join(ends, list(CELL), "left").withColumn("_next", F.coalesce("_next", "_end")).drop("_end")
    return out.select("*", *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns]).drop("_key", "_tie", *CELL, "_next")


def _small(ids: DataFrame) -> DataFrame:
    """A stored list of ids, marked for broadcast up to ``BROADCAST_IDS`` rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text's last third comes from the next document by descending id.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, first_edited (paragraph).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Only texts are shuffled; trees are built where both texts are.
    rows = with_fingerprint(with_fingerprint(neighbours(rows, ["text"]), "text"), "next_text", "next_")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = "concat(substring(text, 1, CAST(n_chars - n_chars DIV 3 AS INT)), substring(next_text, 1, CAST(n_chars DIV 3 AS INT)))"
    rows = with_fingerprint(rows.withColumn("edited", F.expr(edited)), "edited", "edited_")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("leaves", "edited_leaves").alias("near_edited"),
        likeness("leaves", "next_leaves").alias("near_next"),
        first_difference("paragraphs", "edited_paragraphs").alias("first_edited"),
    )
