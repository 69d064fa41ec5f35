"""Quality rules by robust multivariate outliers (minimum covariance determinant).

Everything is DataFrame work: text statistics are array expressions inside one
row, the estimates are grouped moments, and only one row per group ever exists
besides the documents.

Per group (language, source) the statistics vector is standardised by medians
and median deviations, then refined by concentration steps: the mean and
covariance of the share ``h`` of documents with the smallest Mahalanobis
distances, computed anew until the determinant settles, from two starts
(spherical and language-wide); the start with the smaller determinant counts.
Distances are scaled so that their median meets the chi-square median, and a
document is rejected beyond ``cutoff``.  A group with fewer than ``min_group``
documents takes its language's estimate, and a language with fewer the whole
table's.

Null text counts as empty; null language or source is a group of its own;
repeated rows each count and get equal rows; tables with no usable document
give base verdicts only; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
#: Coordinates of the statistics vector and the smallest spread each is given.
VECTOR = {"v_length": 0.35, "v_word": 0.06, "v_symbol": 0.08, "v_line": 0.08, "v_repeat": 0.08}
#: Median of chi-square with five degrees of freedom.
CHI_MEDIAN = 4.351
#: Groups whose estimates may be broadcast (about 250 bytes each).
BROADCAST_GROUPS = 20_000


def text_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, ``keep`` and the base statistics of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(c) for c in keep or []], text.alias("_text")
    ).withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn(
        "_windows",
        F.expr(
            f"CASE WHEN n_words >= {REPEAT_WINDOW} THEN transform(sequence(0, CAST(n_words AS INT) - {REPEAT_WINDOW}), "
            f"i -> xxhash64({', '.join(f'_words[i + {k}]' for k in range(REPEAT_WINDOW))})) ELSE CAST(array() AS ARRAY<BIGINT>) END"
        ),
    )
    # Repeated windows: sort (hash, place); a place counts if a neighbour has its hash.
    repeats = f"""
        CASE WHEN size(array_distinct(_windows)) = size(_windows) THEN 0L ELSE
        aggregate(
          transform(array(sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i)))), s ->
            sort_array(transform(filter(s, (x, j) ->
              (j > 0 AND s[greatest(j - 1, 0)].h = x.h) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h)),
              x -> x.i)))[0],
          struct(-{REPEAT_WINDOW} AS at, 0L AS n),
          (a, p) -> struct(p AS at, a.n + least({REPEAT_WINDOW}, p - a.at) AS n),
          a -> a.n) END"""
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("n_repeat_words", F.expr(repeats).cast("long")).withColumn("_lines", lines)
    return rows.select(
        "doc_id",
        *(keep or []),
        "n_words",
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    root = lambda c, by: F.sqrt(F.col(c) / by)  # noqa: E731  shares: the root steadies their spread
    return {
        "v_length": F.log(words),
        "v_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "v_symbol": root("n_symbols", F.greatest(F.col("word_chars"), F.lit(1))),
        "v_line": root("n_dup_lines", words),
        "v_repeat": root("n_repeat_words", words),
    }


def _moments(names: list[str], inside: Column) -> list[Column]:
    out = [F.sum(F.when(inside, 1.0).otherwise(0.0)).alias("m_n")]
    for i, a in enumerate(names):
        out.append(F.avg(F.when(inside, F.col(a))).alias(f"m_{i}"))
        for j, b in enumerate(names[: i + 1]):
            out.append(F.avg(F.when(inside, F.col(a) * F.col(b))).alias(f"s_{i}_{j}"))
    return out


def _cholesky(groups: DataFrame, names: list[str]) -> DataFrame:
    """Mean and Cholesky factor l_i_j of the covariance, each variance raised by its floor."""
    floors = list(VECTOR.values())
    for i in range(len(names)):
        for j in range(i + 1):
            c = F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + floors[i] ** 2
            for k in range(j):
                c = c - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            c = F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l_{j}_{j}")
            groups = groups.withColumn(f"l_{i}_{j}", c)
    det = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(names))), F.log(F.col("l_0_0")))
    return groups.withColumn("logdet", det)


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i, a in enumerate(names):
        v = F.col(a) - F.col(f"m_{i}")
        for k in range(i):
            v = v - F.col(f"l_{i}_{k}") * y[k]
        y.append(v / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _estimate_columns(names: list[str]) -> list[str]:
    n = len(names)
    return [f"m_{i}" for i in range(n)] + [f"l_{i}_{j}" for i in range(n) for j in range(i + 1)] + ["logdet"]


def _with_groups(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Each document beside its group's estimate.

    Few groups (counted) are broadcast.  Otherwise the estimates are copied to
    16 salts, so a group with a third of all rows meets them in 16 tasks.
    """
    if few:
        return rows.join(F.broadcast(groups), "grp")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(salted, ["grp", "_salt"]).drop("_salt")


def robust_estimates(vectors: DataFrame, h: float = 0.75, steps: int = 4) -> tuple[DataFrame, bool]:
    """One row per ``grp``: mean, Cholesky factor and distance scale; whether they are few.

    ``vectors`` has grp, doc_id and the coordinates; it is read once a step.
    """
    names = list(VECTOR)
    middle = vectors.groupBy("grp").agg(
        *[F.percentile_approx(a, 0.5, 1000).alias(f"m_{i}") for i, a in enumerate(names)],
        *[F.percentile_approx(a, [0.25, 0.75], 1000).alias(f"q_{i}") for i, a in enumerate(names)],
    )
    for i, floor in enumerate(VECTOR.values()):
        for j in range(i):
            middle = middle.withColumn(f"l_{i}_{j}", F.lit(0.0))
        spread = (F.col(f"q_{i}")[1] - F.col(f"q_{i}")[0]) / 1.349
        middle = middle.withColumn(f"l_{i}_{i}", F.greatest(spread, F.lit(floor)))
    spherical = middle.withColumn("logdet", F.lit(float("inf"))).select("grp", *_estimate_columns(names)).checkpoint()
    few = spherical.count() <= BROADCAST_GROUPS
    flat = vectors.agg(*_moments(names, F.lit(True)))
    flat = _cholesky(flat, names).select(*_estimate_columns(names))
    one = flat.first()  # a single row of estimates over all groups
    whole = spherical.select("grp", *[F.lit(one[c]).cast("double").alias(c) for c in _estimate_columns(names) if c != "logdet"])
    starts = [spherical, whole.withColumn("logdet", F.lit(float("inf")))]
    ends = []
    for estimate in starts:
        for _ in range(steps):
            seen = _with_groups(vectors, estimate, few).withColumn("d2", _distance(names)).select("grp", "doc_id", "d2", *names)
            cut = seen.groupBy("grp").agg(F.percentile_approx("d2", h, 2000).alias("cut"))
            inside = _with_groups(seen, cut, few)
            nxt = _cholesky(inside.groupBy("grp").agg(*_moments(names, F.col("d2") <= F.col("cut"))), names)
            estimate = nxt.select("grp", *_estimate_columns(names)).checkpoint()
        ends.append(estimate)
    both = ends[0].withColumn("start", F.lit(0)).unionByName(ends[1].withColumn("start", F.lit(1)))
    cols = _estimate_columns(names)
    best = both.groupBy("grp").agg(F.min_by(F.struct(*cols), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")
    scaled = _with_groups(vectors, best, few).withColumn("d2", _distance(names))
    scale = scaled.groupBy("grp").agg(F.percentile_approx("d2", 0.5, 2000).alias("mid"))
    out = best.join(scale, "grp").withColumn("scale", F.greatest(F.col("mid") / CHI_MEDIAN, F.lit(0.05))).drop("mid")
    return out.checkpoint(), few


def robust_quality(docs: DataFrame, cutoff: float = 65.0, min_group: int = 50, h: float = 0.75) -> DataFrame:
    """doc_id, statistics, base_failed, grp, distance (squared, scaled), kept.

    Estimates are made from the documents that pass the base rules, all of
    them.  ``cutoff`` is far in the tail on purpose (chi-square with five
    degrees of freedom exceeds 65 once in 10^11): statistics of sound texts
    have heavier tails than the normal law.
    """
    stats = text_statistics(docs, ["lang", "source"]).withColumn("base_failed", base_failed()).checkpoint()
    names = list(VECTOR)
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    small, broad = F.to_json(F.array(part("lang"), part("source"))), F.to_json(F.array(part("lang")))
    good = stats.where(~F.col("base_failed")).groupBy(small.alias("g1"), broad.alias("g2")).agg(F.count(F.lit(1)).alias("n"))
    by_lang = good.groupBy("g2").agg(F.sum("n").alias("n2"))
    pick = good.join(by_lang, "g2").select(
        "g1", F.when(F.col("n") >= min_group, F.col("g1")).when(F.col("n2") >= min_group, F.col("g2")).otherwise("[]").alias("grp")
    ).checkpoint()
    few = pick.count() <= BROADCAST_GROUPS
    keyed = stats.withColumn("g1", small).withColumn("g2", broad)
    if few:
        keyed = keyed.join(F.broadcast(pick), "g1", "left")
    else:
        salted = pick.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(salted, ["g1", "_salt"], "left").drop("_salt")
    keyed = keyed.withColumns(_vector())
    # A broader estimate is made from all documents it covers, not only from those that need it.
    wanted = pick.select("grp").distinct()
    cover = keyed.where(~F.col("base_failed")).select("doc_id", *names, F.explode(F.array_distinct(F.array("g1", "g2", F.lit("[]")))).alias("grp"))
    vectors = (cover.join(F.broadcast(wanted), "grp", "left_semi") if few else cover.join(wanted, "grp", "left_semi")).checkpoint()
    estimates, few = robust_estimates(vectors, h)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = keyed.where("base_failed").select(*cols, F.lit(None).cast("string").alias("grp"), F.lit(None).cast("double").alias("distance"))
    judged = _with_groups(keyed.where(~F.col("base_failed")), estimates, few)
    judged = judged.select(*cols, "grp", (_distance(names) / F.col("scale")).alias("distance"))
    return failed.unionByName(judged).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))
