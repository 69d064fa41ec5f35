"""Byte-pair encoding by batched numpy merge rounds, and decoding.

The distinct words of a batch lie in one flat symbol array.  Each round looks
up the rank of every adjacent pair by binary search over the sorted pair keys,
takes the lowest rank of each word and merges its places.  Words that are done
leave the array.  Results equal the tokenizers library's for vocabularies of
the kind "BPE with word ends" (NFC, white space folded, lower case, no decoder:
tokens are joined by one space).

A merge is applied to all its places of a word at once if no pair with its
result ranks lower than itself; otherwise one place a round, leftmost first,
which is the library's order.

Null text counts as empty; empty tables give empty results; repeated rows give
one row each; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradelens.llm.flat import doc_slices, flat_text, id_text

#: Distinct chunks between white space remembered by a task before its cache starts anew.
CACHE_CHUNKS = 300_000
_SHIFT = 20
_NONE = np.int64(1 << 40)
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_ASCII_KIND = np.full(256, _OTHER, np.uint8)
_ASCII_KIND[97:123] = _LETTER
_ASCII_KIND[48:58] = _DIGIT


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def _replaced(ids: np.ndarray, first: np.ndarray, words: list[int], by: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``words`` becomes the single id ``by``."""
    if not words:
        return ids, first
    size = np.diff(first)
    keep = np.ones(len(ids), bool)
    for w in words:
        keep[first[w] + 1 : first[w + 1]] = False
    ids = ids.copy()
    ids[first[words]] = by
    size[words] = 1
    return ids[keep], np.r_[0, np.cumsum(size)]


class WordBpe:
    """A vocabulary file's merges as sorted arrays, with word-level encoding."""

    def __init__(self, path: str) -> None:
        import re

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        lowest = np.full(max(vocab.values()) + 2, len(merges), np.int64)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.at_once = lowest[made] > rank
        self.made = made
        order = np.argsort((left << _SHIFT) | right)
        self.keys, self.rank = ((left << _SHIFT) | right)[order], rank[order]
        token = {i: t.encode() for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token.update({i: t.encode() for t, i in added.items()})
        strings = [token.get(i, b"") + b" " for i in range(max(token) + 1)]
        self.token_at = np.cumsum([0, *map(len, strings)])
        self.token_bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.added_ids = {t.encode(): i for t, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        # The pre-tokeniser's pattern; white space is Unicode's. Fixed values.
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
        )
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.ids_of: dict[bytes, bytes] = {}
        self.text_of: dict[bytes, bytes] = {}

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words in order; an added token's string stands for itself."""
        if self.special is None or "<" not in text:
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out.extend((" " + part,) if k % 2 else self.words(part))
        return out

    def plain_words(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, word sizes and words per chunk of ASCII chunks without ' and <, by character class."""
        buf = _ASCII_LOWER[np.frombuffer(b"".join(chunks), np.uint8)]
        kind = _ASCII_KIND[buf]
        first = np.cumsum([0, *map(len, chunks)])
        begins = kind == _DIGIT
        begins[1:] |= kind[1:] != kind[:-1]
        begins[first[:-1]] = True
        starts = np.flatnonzero(begins)
        return buf, np.diff(np.r_[starts, len(buf)]), np.diff(np.searchsorted(starts, first))

    def learn(self, chunks: list[bytes]) -> None:
        """Encode the chunks that the cache lacks, all together."""
        plain = [c for c in chunks if c.isascii() and b"'" not in c and b"<" not in c]
        other = list(set(chunks).difference(plain)) if len(plain) < len(chunks) else []
        if plain:
            buf, sizes, per_chunk = self.plain_words(plain)
            self.keep(plain, *self.merge(buf, sizes), per_chunk)
        if other:
            split = [self.pieces(c.decode("utf-8", "replace")) for c in other]
            flat = [w.encode() for ws in split for w in ws]
            if flat:
                buf = np.frombuffer(b"".join(flat), np.uint8)
                ids, first = self.merge(buf, np.array([len(w) for w in flat]))
                for t, i in self.added_ids.items():
                    spots = [k for k, w in enumerate(flat) if w == b" " + t]
                    ids, first = _replaced(ids, first, spots, i)
                self.keep(other, ids, first, np.array([len(ws) for ws in split]))
            else:
                self.ids_of.update(dict.fromkeys(other, b""))
                self.text_of.update(dict.fromkeys(other, b""))

    def keep(self, chunks: list[bytes], ids: np.ndarray, first: np.ndarray, per_chunk: np.ndarray) -> None:
        """Remember each chunk's ids and decoded text; words hold ids[first[w]:first[w + 1]]."""
        edges = first[np.r_[0, np.cumsum(per_chunk)]]
        raw, text, at = ids.astype("<u4").tobytes(), *self.decoded(ids)
        cut, text_cut = (4 * edges).tolist(), at[edges].tolist()
        self.ids_of.update(zip(chunks, [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True))
        self.text_of.update(
            zip(chunks, [text[a : max(a, b - 1)] for a, b in zip(text_cut[:-1], text_cut[1:], strict=True)], strict=True)
        )

    def decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All tokens' strings, each followed by a space, and where each token begins."""
        size = np.diff(self.token_at)[ids]
        at = np.r_[0, np.cumsum(size)]
        source = np.repeat(self.token_at[ids] - at[:-1], size) + np.arange(at[-1])
        return self.token_bytes[source].tobytes(), at

    def merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words (their bytes in one array) and each word's first place."""
        ends = np.cumsum(size)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(size)), size)
        done_symbols, done_words = [], []
        rank = np.full(len(symbols), _NONE)
        changed = np.arange(len(symbols) - 1)
        while len(symbols):
            if len(changed):  # only pairs next to a merge are looked up again
                key = (symbols[changed] << _SHIFT) | symbols[changed + 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (word[changed] == word[changed + 1])
                rank[changed] = np.where(hit, self.rank[at], _NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(symbols)])
            low_each = np.repeat(low, length)
            finished = low_each == _NONE
            done_symbols.append(symbols[finished])
            done_words.append(word[finished])
            spots = np.flatnonzero((rank == low_each) & ~finished)
            if not len(spots):
                break
            # Overlapping places are consecutive (a a a): every other one counts.
            fresh = np.r_[True, (spots[1:] != spots[:-1] + 1) | (word[spots[1:]] != word[spots[:-1]])]
            run = np.cumsum(fresh) - 1
            spots_ok = (np.arange(len(spots)) - np.flatnonzero(fresh)[run]) % 2 == 0
            one = ~self.at_once[low_each[spots]]
            leading = np.r_[True, word[spots[1:]] != word[spots[:-1]]]
            spots = spots[np.where(one, leading, spots_ok)]
            symbols[spots] = self.made[rank[spots]]
            keep = ~finished
            keep[spots + 1] = False
            rank[spots] = _NONE
            dirty = np.zeros(len(symbols), bool)
            dirty[spots] = True
            symbols, word, rank, dirty = symbols[keep], word[keep], rank[keep], dirty[keep]
            dirty[:-1] |= dirty[1:]
            dirty[-1:] = False  # the last symbol has no pair
            changed = np.flatnonzero(dirty)
        ids, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(size)))]

    def encode_batch(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Little-endian ids and decoded UTF-8 of each text.

        Texts are cut at ASCII white space, which the pattern drops and no word
        crosses; each distinct chunk is encoded once.
        """
        if len(self.ids_of) > CACHE_CHUNKS:
            self.ids_of, self.text_of = {}, {}
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.ids_of)
        if new:
            self.learn(list(new))
        ids_of, text_of = self.ids_of.__getitem__, self.text_of.__getitem__
        return [(b"".join(map(ids_of, c)), b" ".join(filter(None, map(text_of, c)))) for c in split]

    def decode(self, ids: bytes) -> str:
        return self.decoded(np.frombuffer(ids, "<u4").astype(np.int64))[0][:-1].decode()


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(vocabulary)
        for b in batches:
            _, offsets = flat_text(b.column("text"))
            for lo, hi in doc_slices(offsets, 1 << 20):
                part = b.slice(lo, hi - lo)
                rows = bpe.encode_batch(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([r[0] for r in rows], pa.binary()),
                        pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")
