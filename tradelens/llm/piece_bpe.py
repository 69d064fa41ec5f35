"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

The library merges, again and again, the adjacent pair whose concatenation is
the piece with the best score (leftmost of equals).  A sequence of symbols is
that procedure's result exactly if every two neighbours, merged anew on their
own, come out as these two: until a first merge crosses a boundary, the pair
alone goes through the same merges in the same order as inside the text.

So the encoder walks from left to right.  An Aho-Corasick automaton lists all
pieces that begin at a place; the longest that is compatible with the symbol
before (checked by re-merging the two, remembered per pair) and does not end at
a place known to fail is taken.  Where none is left, the place is marked in a
bitfield and the symbol before gives way to its next shorter one.  A place that
failed once fails always, since the symbols up to it are unique.

Texts are cut into chunks that no piece crosses (before a white-space sign that
follows something else, around characters that never merge); each distinct chunk
is encoded once per task and remembered.  A chunk without such a boundary may be
as long as the text and is handled whole, with one number a character.

Null text counts as empty (no ids, empty text); repeated rows give one row each;
empty tables give empty results; other columns are ignored.  Models with user
defined symbols, a character map or another model type are refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradelens.llm.flat import doc_slices, flat_text, id_text

SPACE = "▁"  # stands for a space inside pieces
#: Distinct chunks and pairs remembered by a task before its caches start anew.
CACHE_CHUNKS, CACHE_PAIRS = 400_000, 2_000_000
#: Longest chunk (characters) that is remembered; symbol numbers stay below 2^PAIR_SHIFT.
CACHE_LENGTH, PAIR_SHIFT = 64, 22
#: Kinds of pieces in a model file. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2


class PieceBpe:
    """A model's pieces with encoding by backtracking."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != MERGE_TYPE or norm.precompiled_charsmap or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only merge-type models without character map and user defined pieces are supported")
        if norm.remove_extra_whitespaces or not norm.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only models that keep white space and fall back to bytes are supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        unknown_text = model.trainer_spec.unk_surface.encode()
        strings = [
            {NORMAL: p.piece.replace(SPACE, " ").encode(), UNKNOWN: unknown_text}.get(p.type, b"") for p in model.pieces
        ]
        for byte, i in self.byte_id.items():
            strings[i] = bytes([byte])
        self.piece_at = np.cumsum([0, *map(len, strings)])
        self.piece_bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.text_of = [p.piece if p.type == NORMAL else "" for p in model.pieces]
        self.size = list(map(len, self.text_of))
        self.char_id = {p: i for p, i in self.id_of.items() if len(p) == 1}
        self.expands: dict[int, list[int]] = {}
        self.shorter = [-1] * len(self.text_of)
        self.automaton = ahocorasick.Automaton()
        long = [p for p in self.score if len(p) > 1]
        for piece in long:
            self.automaton.add_word(piece, (self.id_of[piece], len(piece) - 1))
            prefix = next((piece[:k] for k in range(len(piece) - 1, 1, -1) if piece[:k] in self.id_of), piece[0])
            self.shorter[self.id_of[piece]] = self.symbol(prefix)
        if long:
            self.automaton.make_automaton()
        merging = set("".join(long))
        self.neighbours = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        #: Characters that never merge: one stands between chunks, the ASCII ones are chunks of their own.
        self.wall = next(chr(c) for c in range(0xD800) if chr(c) not in merging)
        lone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in merging))
        spaced = any(a != SPACE and b == SPACE for a, b in self.neighbours)
        # A white-space sign begins a chunk unless some piece has one behind another character.
        self.chunk = re.compile(f"[{lone}]|[^{lone}]+" if spaced else f"[{lone}]|{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+")
        self.fitting: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def symbol(self, text: str) -> int:
        """Number of a symbol: a piece's id, or one of its own for a character without a piece."""
        i = self.id_of.get(text)
        if i is None:
            i = self.char_id.get(text)
        if i is None:
            i = self.char_id[text] = len(self.text_of)
            self.expands[i] = [self.byte_id.get(b, self.unknown) for b in text.encode()]
            self.text_of.append(text)
            self.size.append(1)
            self.shorter.append(-1)
        return i

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself, for short strings."""
        symbols, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def stands(self, symbol: int) -> bool:
        """Whether the symbol alone is merged into itself."""
        known = self.sound.get(symbol)
        if known is None:
            text = self.text_of[symbol]
            known = self.sound[symbol] = len(text) == 1 or self.merged(text) == [text]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two symbols stay as they are when they are merged anew."""
        if len(self.fitting) >= CACHE_PAIRS:
            self.fitting.clear()
        fit = self.stands(left) and self.stands(right)
        if fit:
            a, b = self.text_of[left], self.text_of[right]
            fit = a[-1] + b[0] not in self.neighbours or self.merged(a + b) == [a, b]
        self.fitting[left << PAIR_SHIFT | right] = fit
        return fit

    def longest_at(self, text: str) -> list[int]:
        """The longest symbol that begins at each place."""
        char_id = self.char_id
        for c in set(text).difference(char_id):
            self.symbol(c)
        out = list(map(char_id.__getitem__, text))
        if self.automaton.kind:
            for end, (piece, back) in self.automaton.iter(text):
                out[end - back] = piece  # ends ascend, so the last piece of a place is its longest
        return out

    def backtrack(self, longest: list[int], lo: int, hi: int) -> list[int]:
        """The merge procedure's symbols of the chunk at [lo, hi)."""
        size, shorter, fitting = self.size, self.shorter, self.fitting
        at, token, out = lo, longest[lo], []
        failed = None
        while at < hi:
            while token >= 0:
                end = at + size[token] - lo
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if out:
                        fit = fitting.get(out[-1] << PAIR_SHIFT | token)
                        if fit is None:
                            fit = self.fits(out[-1], token)
                    else:
                        fit = self.stands(token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end + lo
                token = longest[at]  # behind the last place stands a wall
            else:
                if failed is None:
                    failed = bytearray((hi - lo) // 8 + 1)
                failed[(at - lo) >> 3] |= 1 << ((at - lo) & 7)
                last = out.pop()
                at -= size[last]
                token = shorter[last]
        return out

    def learn(self, chunks: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each chunk."""
        longest = self.longest_at(self.wall.join([*chunks, ""]))
        expands, at = self.expands, 0
        for chunk in chunks:
            ids = self.backtrack(longest, at, at + len(chunk))
            at += len(chunk) + 1
            if expands and not expands.keys().isdisjoint(ids):
                ids = [j for i in ids for j in expands.get(i, (i,))]
            yield struct.pack(f"<{len(ids)}i", *ids)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's first place in it."""
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        known = self.known
        split = [self.chunk.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set().union(*split).difference(known))
        known.update(zip(new, self.learn(new), strict=True))
        rows = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for chunk in new:
            if len(chunk) > CACHE_LENGTH:
                del known[chunk]
        return np.frombuffer(b"".join(rows), "<i4"), np.cumsum([0, *map(len, rows)]) // 4

    def decode_batch(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts whose ids lie in ids[first[i]:first[i + 1]], and their offsets."""
        size = np.diff(self.piece_at)[ids]
        at = np.r_[0, np.cumsum(size)]
        out = self.piece_bytes[np.repeat(self.piece_at[ids] - at[:-1], size) + np.arange(at[-1])]
        offsets = at[first]
        if self.prefix:  # a space that a text's first piece begins with is the dummy prefix
            begins = offsets[:-1][first[1:] > first[:-1]]
            begins = begins[out[begins] == ord(" ")]
            out = np.delete(out, begins)
            offsets = offsets - np.searchsorted(begins, offsets)
        return out, offsets


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every whole text.

    ``model`` is the path of a sentencepiece model file, present on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe(model)
        for b in batches:
            _, offsets = flat_text(b.column("text"))
            for lo, hi in doc_slices(offsets, 1 << 20):
                part = b.slice(lo, hi - lo)
                ids, first = bpe.encode_batch(part.column("text").to_pylist())
                decoded, ends = bpe.decode_batch(ids, first)
                text = pa.Array.from_buffers(
                    pa.large_string(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(decoded)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32())),
                        text.cast(pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
