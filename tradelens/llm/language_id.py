"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary.  A
word's probability is the sum over all its segmentations into pieces, computed
by a forward algorithm over its characters; a text's is the product over its
words.  Piece probabilities are fitted by expectation maximisation: Spark counts
words per language, and every step sums expected piece counts over partitions
of that word table.

The fit uses a bounded sample of labelled documents per language (a hash of the
id picks them); prediction covers every whole text.  Words are runs between
white space without their non-letters, in lower case; a longer word is fitted
on and scored in parts of ``LONGEST`` characters, the mark of its start included.

Null text, and text without a letter, is ``und`` with score 0; rows with null
language are predicted but not learned from; with nothing to learn every row is
``und``; repeated rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.flat import mix64, prefix_sums, span_hash
from tradelens.llm.stored import stored

#: Labelled documents per language that the fit reads, about; languages at most.
SAMPLE_DOCS, MAX_LANGUAGES = 4_000, 500
#: Longest piece and word part in characters; word mark of the vocabulary.
LONGEST_PIECE, LONGEST, MARK = 12, 40, "▁"
#: Distinct chunks remembered by a task.
CACHE_CHUNKS = 200_000
#: Rows handled, and given back, at once.
SLICE_ROWS = 500
_NOT_LETTERS = re.compile(r"[\W\d_]+")


class Pieces:
    """The vocabulary's pieces by length, for lookup of all substrings at once."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(len(names))]
        self.names = sorted({n for n, p in zip(names, plain, strict=True) if p and n == n.lower() and 0 < len(n) <= LONGEST_PIECE})
        self.size = len(self.names)  # id `size`: no piece; `size` + 1: an unknown character
        keys, ids = [[] for _ in range(LONGEST_PIECE + 1)], [[] for _ in range(LONGEST_PIECE + 1)]
        at = np.cumsum([0, *map(len, self.names)])
        hashes = span_hash(self.sums(self.names), at[:-1], at[1:])
        for i, (n, h) in enumerate(zip(self.names, hashes.tolist(), strict=True)):
            keys[len(n)].append(h)
            ids[len(n)].append(i)
        self.keys, self.ids = [], []
        for k, i in zip(keys, ids, strict=True):
            order = np.argsort(np.array(k, np.uint64))
            self.keys.append(np.array(k, np.uint64)[order])
            self.ids.append(np.array(i, np.int64)[order])

    def sums(self, words: list[str]) -> np.ndarray:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return prefix_sums(mix64(chars.astype(np.uint64) + np.uint64(1)))

    def lattices(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per word length n: the words' places, and piece ids [word, start, length - 1]."""
        if not words:
            return
        sums, size = self.sums(words), np.array([len(w) for w in words])
        first = np.r_[0, np.cumsum(size)]
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            out = np.full((len(rows), n, min(n, LONGEST_PIECE)), self.size, np.int32)
            for k in range(1, min(n, LONGEST_PIECE) + 1):
                if not len(self.keys[k]):
                    continue
                start = first[rows][:, None] + np.arange(n - k + 1)[None, :]
                h = span_hash(sums, start.ravel(), start.ravel() + k).reshape(start.shape)
                at = np.minimum(np.searchsorted(self.keys[k], h), len(self.keys[k]) - 1)
                found = np.where(self.keys[k][at] == h, self.ids[k][at], self.size if k > 1 else self.size + 1)
                out[:, : n - k + 1, k - 1] = found
            yield rows, out


def forward(lattice: np.ndarray, table: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: sum over segmentations of the first characters."""
    m, n, longest = lattice.shape
    alpha = np.zeros((m, n + 1, table.shape[1]))
    alpha[:, 0] = 1.0
    for t in range(1, n + 1):
        for k in range(1, min(t, longest) + 1):
            alpha[:, t] += alpha[:, t - k] * table[lattice[:, t - k, k - 1]]
    return alpha


def expected_counts(lattice: np.ndarray, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of every piece, words weighted; ``table`` is one language's column."""
    m, n, longest = lattice.shape
    alpha = forward(lattice, table[:, None])[:, :, 0]
    beta = np.zeros((m, n + 1))
    beta[:, n] = 1.0
    for t in range(n - 1, -1, -1):
        for k in range(1, min(n - t, longest) + 1):
            beta[:, t] += table[lattice[:, t, k - 1]] * beta[:, t + k]
    scale = weight / np.maximum(alpha[:, n], 1e-300)
    out = np.zeros(len(table))
    for t in range(n):
        for k in range(1, min(n - t, longest) + 1):
            ids = lattice[:, t, k - 1]
            out += np.bincount(ids, alpha[:, t] * table[ids] * beta[:, t + k] * scale, minlength=len(table))
    return out


def letters(chunk: str) -> str:
    return chunk if chunk.isalpha() else _NOT_LETTERS.sub("", chunk)


def word_parts(word: str) -> list[str]:
    marked = MARK + word
    return [marked[i : i + LONGEST] for i in range(0, len(marked), LONGEST)]


@dataclass(frozen=True)
class LanguageModel:
    """languages and log-free piece probabilities [piece, language]."""

    vocabulary: str
    languages: list[str]
    table: np.ndarray


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Columns of piece probabilities, with a small share for pieces a language lacks."""
    size = len(counts) - 2
    pieces = counts[:size] + 0.01
    table = np.zeros_like(counts)
    table[:size] = pieces / pieces.sum(axis=0)
    table[size + 1] = 1e-8
    return table


def fit(labelled: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS, rounds: int = 3) -> LanguageModel:
    """Piece probabilities from text and lang of the rows given (doc_id picks the sample)."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = rows.groupBy(F.col("lang").cast("string").alias("lang")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in totals)
    if not languages:
        return LanguageModel(vocabulary, [], np.zeros((0, 0)))
    share = {r["lang"]: min(1.0, sample_docs / r["count"]) for r in totals}
    place = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) / (1 << 20)
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    picked = rows.where(place < limit[F.col("lang").cast("string")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                per.setdefault(lang, Counter()).update(text.lower().split())
            for lang, raw in per.items():
                words: Counter = Counter()
                for chunk, n in raw.items():
                    if w := letters(chunk):
                        for part in word_parts(w):
                            words[part] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                    ["lang", "word", "n"],
                )

    words = picked.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = words.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "lang-words")
    size = Pieces(vocabulary).size
    table = _smoothed(np.ones((size + 2, len(languages))))
    for _ in range(rounds):
        model = LanguageModel(vocabulary, languages, table)

        def expect(batches: Iterator[pa.RecordBatch], model: LanguageModel = model) -> Iterator[pa.RecordBatch]:
            pieces = Pieces(model.vocabulary)
            total = np.zeros_like(model.table)
            for b in batches:
                lang, n = np.array(b.column("lang").to_pylist()), b.column("n").to_numpy()
                words = b.column("word").to_pylist()
                for j, name in enumerate(model.languages):
                    own = np.flatnonzero(lang == name)
                    for at, lattice in pieces.lattices([words[i] for i in own]):
                        total[:, j] += expected_counts(lattice, model.table[:, j], n[own][at])
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["piece", "language", "n"]
            )

        sums = words.mapInArrow(expect, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(table)
        counts[sums["piece"].to_numpy(), sums["language"].to_numpy()] = sums["n"].to_numpy()
        table = _smoothed(counts)
    return LanguageModel(vocabulary, languages, table)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns (default doc_id), lang_pred and score (the language's posterior) of every row.

    ``text`` names the text, which may be a field of a kept struct (``_doc.text``):
    then it crosses to Python once.  Rows come back in slices of ``SLICE_ROWS``.
    """
    keep = keep or ["doc_id"]
    whole, _, name = text.partition(".")
    inside = keep.index(whole) if name else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.vocabulary)
        count = len(model.languages)
        known: dict[str, int] = {}
        logs = np.zeros((0, count))
        slices = (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))
        for b in slices:
            column = b.column("_text") if inside is None else pc.struct_field(b.column(inside), name).cast(pa.string())
            texts = column.to_pylist()
            names, scores = [], []
            split = [(t or "").lower().split() for t in texts]
            if len(known) > CACHE_CHUNKS:
                known, logs = {}, np.zeros((0, count))
            new = list(set().union(*split).difference(known))
            logs = np.concatenate([logs, _chunk_logs(new, pieces, model.table, count)])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            for text, chunks in zip(texts, split, strict=True):
                if not count or not text or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = logs[np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0)
                best = int(total.argmax())
                names.append(model.languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            kept = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [f"c{i}" for i in range(len(keep))] + ["lang_pred", "score"]
            )

    apart = [F.col(text).cast("string").alias("_text")] if inside is None else []
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *apart)
    schema = ", ".join([f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))] + ["lang_pred string", "score double"])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def _chunk_logs(chunks: list[str], pieces: Pieces, table: np.ndarray, count: int) -> np.ndarray:
    """Natural log probability of each chunk's letters under every language."""
    out = np.zeros((len(chunks), count))
    if not count:
        return out
    words = [letters(c) for c in chunks]
    parts = [(i, p) for i, w in enumerate(words) if w for p in word_parts(w)]
    owner = np.array([i for i, _ in parts], np.int64)
    for rows, lattice in pieces.lattices([p for _, p in parts]):
        np.add.at(out, owner[rows], np.log(np.maximum(forward(lattice, table)[:, -1], 1e-300)))
    return out


def crc_remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; null ids have none."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))
