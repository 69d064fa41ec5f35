"""A hidden Markov language model over words, trained by Baum-Welch.

Words are lower-cased (A-Z) runs between ASCII white space, and each text ends
with one end token.  Word counts of the training texts are summed by Spark;
the commonest ``COMMON`` words are shipped to tasks (a fixed bound), all others
are looked up by a join.  A state emits one of ``SYMBOLS`` words, the end, or a
class of the remaining words (by their last letters); within a class a word
has its smoothed share of the class's counts.

Each round's expected counts cover all training texts; they are summed per
partition and then by Spark, with the round's log likelihood.  Scoring is the
scaled forward recursion over the whole text: the exact likelihood.  Sequences
of over ``LONGEST`` tokens are trained on in consecutive parts, each with a
start of its own (never scored so): a time step then has many rows.

Null text counts as empty (one end token); equal rows get equal rows; with
nothing to train on the base model gives every token probability 1 over V + 1;
extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.flat import id_text
from tradelens.llm.stored import stored

COMMON, SYMBOLS, CLASSES = 1 << 18, 1 << 13, 1 << 11
STATES = 8
#: Baum-Welch rounds; each reads all training texts.
ROUNDS = 8
#: Tokens of a training part.
LONGEST = 512
_FLUSH = 300_000


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c: counts over all texts given, without the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for text in b.column("text").cast(pa.binary()).to_pylist():
                seen.update(text.lower().split())
                if len(seen) > _FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return texts.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """Common words by count, class totals, and the corpus totals N and V."""

    words: bytes  # joined by a space
    counts: np.ndarray
    class_log: np.ndarray  # log10 of each class's denominator
    n: int
    v: int
    end: int

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split(b" "))} if self.words else {}


def lexicon(counts: DataFrame, n_texts: int) -> Lexicon:
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    common = counts.orderBy(F.desc("c"), "word").limit(COMMON).toArrow()
    words, uses = common.column("word").to_pylist(), common.column("c").to_numpy()
    classes_n, classes_v = np.zeros(CLASSES), np.zeros(CLASSES)
    if len(words) > SYMBOLS:  # classes hold every word that is not a symbol of its own
        c, word = int(uses[SYMBOLS]), words[SYMBOLS]
        rest = counts.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") >= F.lit(word))))
        key = F.pmod(F.crc32(F.expr("substring(word, greatest(1, octet_length(word) - 2), 3)")), F.lit(CLASSES))
        for r in rest.groupBy(key.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            classes_n[r["k"]], classes_v[r["k"]] = r["n"], r["v"]
    n, v = int(total["n"] or 0) + n_texts, int(total["v"]) + (1 if n_texts else 0)
    return Lexicon(
        b" ".join(words),
        uses.astype(np.int64),
        np.log10(classes_n + classes_v + 1.0),
        n,
        v,
        n_texts,
    )


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # [state]
    move: np.ndarray  # [state, state]
    emit: np.ndarray  # [symbol, state]
    #: Natural log likelihood of the training parts before each round.
    history: tuple[float, ...] = ()


#: Symbol of the end token; classes follow it.
END = SYMBOLS


def initial(seed: int = 5) -> Hmm:
    rng = np.random.default_rng(seed)
    size = SYMBOLS + 1 + CLASSES
    emit = rng.gamma(1.0, size=(size, STATES)) + 0.2
    move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
    return Hmm(np.full(STATES, 1.0 / STATES), move, emit / emit.sum(axis=0))


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by length (longest first), symbols time by time, and rows alive at each time."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    first = np.r_[0, np.cumsum(alive)]
    flat = np.empty(first[-1], np.int64)
    for row, i in enumerate(order):
        flat[first[: size[row]] + row] = seqs[i]
    return order, flat, first


def log_likelihood(seqs: list[np.ndarray], hmm: Hmm) -> np.ndarray:
    """Natural log likelihood of each symbol sequence by the scaled forward recursion."""
    order, flat, first = _padded(seqs)
    out = np.zeros(len(seqs))
    emitted = hmm.emit[flat[: first[1]]]
    alpha = hmm.start * emitted
    for t in range(len(first) - 1):
        if t:
            emitted = hmm.emit[flat[first[t] : first[t + 1]]]
            alpha = (alpha[: len(emitted)] @ hmm.move) * emitted
        scale = alpha.sum(axis=1)
        out[: len(scale)] += np.log(scale)
        alpha /= scale[:, None]
    result = np.empty(len(seqs))
    result[order] = out
    return result


def baum_welch_counts(seqs: list[np.ndarray], hmm: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected start, move and emission counts of the sequences."""
    return expected_counts(seqs, hmm)[:3]


def expected_counts(seqs: list[np.ndarray], hmm: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected start, move and emission counts of the sequences and their natural log likelihood."""
    _, flat, first = _padded(seqs)
    steps = len(first) - 1
    # States are rows here: sums and products run over consecutive tokens.
    emitted = np.take(np.ascontiguousarray(hmm.emit.T), flat, axis=1)
    step = np.ascontiguousarray(hmm.move.T)
    alpha, scale = np.empty_like(emitted), np.empty(len(flat))
    for t in range(steps):
        a, b = first[t], first[t + 1]
        now = alpha[:, a:b]
        before = step @ alpha[:, first[t - 1] : first[t - 1] + b - a] if t else hmm.start[:, None]
        np.multiply(before, emitted[:, a:b], out=now)
        scale[a:b] = 1.0 / now.sum(axis=0)
        now *= scale[a:b]
    move = np.zeros((STATES, STATES))
    beta = np.ones((STATES, 0))
    for t in range(steps - 1, -1, -1):
        a, b = first[t], first[t + 1]
        back = np.ones((STATES, b - a))
        if t + 1 < steps:
            c, d = first[t + 1], first[t + 2]
            later = emitted[:, c:d] * beta
            later *= scale[c:d]
            move += alpha[:, a : a + d - c] @ later.T
            np.matmul(hmm.move, later, out=back[:, : d - c])
        beta = back
        alpha[:, a:b] *= back
    alpha /= alpha.sum(axis=0)
    emit = np.stack([np.bincount(flat, g, minlength=len(hmm.emit)) for g in alpha], axis=1)
    return alpha[:, : first[1]].sum(axis=1), move * hmm.move, emit, -float(np.log(scale).sum())


def _symbols(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """doc_id, held_out, n_tokens, seq (symbols, unsigned 16-bit) and sums over common words; rare: words and their uses.

    head_log and head_known are the base model's parts of common words,
    class_log the log10 shares of words within their classes (common ones).
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        index = lex.index()
        log_c = np.log10(lex.counts + 1.0)
        symbol = np.empty(len(index), np.int64)
        symbol[:SYMBOLS] = np.arange(min(SYMBOLS, len(index)))
        for w, i in index.items():
            if i >= SYMBOLS:
                symbol[i] = END + 1 + word_class(w)
        for b in batches:
            ids, held = b.column("doc_id"), b.column("held_out")
            out = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = text.lower().split()
                at = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
                common = at >= 0
                seq = np.empty(len(words) + 1, "<u2")
                seq[-1] = END
                seq[:-1][common] = symbol[at[common]]
                rare = [words[i] for i in np.flatnonzero(~common)]
                seq[:-1][~common] = [END + 1 + word_class(w) for w in rare]
                uses = Counter(rare)
                classed = seq[:-1][seq[:-1] > END] - END - 1
                log_in = log_c[at[common & (at >= SYMBOLS)]].sum() - lex.class_log[classed].sum()
                out.append((len(seq), seq.tobytes(), float(log_c[at[common]].sum()), int(common.sum()), float(log_in), list(uses), list(uses.values())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [ids, held, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                ["doc_id", "held_out", "n_tokens", "seq", "head_log", "head_known", "class_log", "rare", "uses"],
            )

    return texts.mapInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, seq binary, head_log double, head_known long, class_log double, rare array<binary>, uses array<int>",
    )


def _groups(b: pa.RecordBatch, most: int, column: str = "seq") -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and sequences of consecutive rows with about ``most`` tokens together."""
    rows, size, first = [], 0, 0
    for i, raw in enumerate(b.column(column)):
        s = np.frombuffer(raw.as_buffer(), "<u2")
        if rows and size + len(s) > most:
            yield first, rows
            rows, size, first = [], 0, i
        rows.append(s)
        size += len(s)
    if rows:
        yield first, rows


def train(seqs: DataFrame, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over ``seq`` (16-bit symbols); each round reads all rows.  Without a row the initial model stays."""
    hmm = initial()
    spark = seqs.sparkSession
    size = len(hmm.emit)
    sums = [F.sum(f"g{k}").alias(f"g{k}") for k in range(STATES)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(hmm)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hmm = shared.value
            total = np.zeros((size + STATES + 2, STATES))  # emissions, moves, start, likelihood (in the first state)
            for b in batches:
                for _, rows in _groups(b, 1 << 18):
                    parts = [s[i : i + LONGEST] for s in rows for i in range(0, len(s), LONGEST)]
                    start, move, emit, log = expected_counts(parts, hmm)
                    total[:size] += emit
                    total[size:-2] += move
                    total[-2] += start
                    total[-1, 0] += log
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, k]) for k in range(STATES)]], ["at", *[f"g{k}" for k in range(STATES)]])

        got = seqs.select("seq").mapInArrow(expect, "at int, " + ", ".join(f"g{k} double" for k in range(STATES))).groupBy("at").agg(*sums).toArrow()
        if not got.num_rows:
            break
        total = np.zeros((size + STATES + 2, STATES))
        total[got["at"].to_numpy()] = np.stack([got[f"g{k}"].to_numpy() for k in range(STATES)], axis=1)
        emit, move, start = total[:size], total[size:-2], total[-2]
        overall = emit.sum(axis=1, keepdims=True) + 0.5
        emit = emit + 20.0 * overall / overall.sum()  # a little of the pooled emissions
        move, start = move + 0.1, start + 0.1
        hmm = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), (*hmm.history, float(total[-1, 0])))
    return hmm


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every text.

    ``held_out`` is a boolean column over docs; other rows (null, too) are trained on.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    counts = stored(word_counts(rows.where(~F.col("held_out"))), "word-counts")
    lex = lexicon(counts, rows.where(~F.col("held_out")).count())
    # Row numbers are fixed once written; equal rows have different ones.
    seqs = stored(_symbols(rows, lex).withColumn("row", F.monotonically_increasing_id()), "symbols")
    hmm = train(seqs.where(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(hmm)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = [log_likelihood(rows, shared.value) for _, rows in _groups(b, 1 << 20)]
            out = np.concatenate(logs) / math.log(10) if logs else np.zeros(0)
            names = ["row", "doc_id", "held_out", "n_tokens", "head_log", "head_known", "class_log"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(out)], [*names, "hmm_log"])

    scored = seqs.select("row", "doc_id", "held_out", "n_tokens", "head_log", "head_known", "class_log", "seq").mapInArrow(
        score, "row long, doc_id long, held_out boolean, n_tokens long, head_log double, head_known long, class_log double, hmm_log double"
    )
    uses = seqs.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "uses")).alias("e"))
    uses = uses.select("row", F.col("e.rare").alias("word"), F.col("e.uses").alias("uses"))
    found = uses.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("uses") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("uses").alias("rare_known")
    )
    out = scored.join(found, "row", "left").fillna(0, ["rare_log", "rare_known"])
    end_c, end_known = lex.end, 1 if lex.end else 0
    base = F.col("head_log") + F.col("rare_log") + F.lit(math.log10(end_c + 1.0)) - F.col("n_tokens") * F.lit(math.log10(lex.n + lex.v + 1.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.col("rare_known") + end_known).cast("long").alias("n_known"),
        F.lit(lex.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("hmm_log") + F.col("class_log") + F.col("rare_log")).alias("score"),
    )
