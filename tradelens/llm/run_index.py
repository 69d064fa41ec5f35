"""A run-length index over many short byte strings, held by one task.

The Burrows-Wheeler transform of the strings (each ended by its own separator)
is kept as runs: a run's letter, first row, count of the letter before it, and
the text places sampled at its first and last row.  Patterns are streamed from
right to left, all in lock step: a pointer (row and text place) follows the LF
mapping while the run's letter fits, and otherwise jumps to the end of the
nearest run of the letter above or below, whichever place shares more with the
pattern.  That gives matching statistics, here up to ``cap`` bytes, and for
full matches the class of rows that share the ``cap`` bytes with the smallest
owner in it.
"""

from __future__ import annotations

import numpy as np

from tradelens.llm.flat import mix64, prefix_sums, sums_windows


def suffix_order(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffix array of the strings text[first[k]:first[k + 1]], each ended by a separator of its own.

    Separators sort before all bytes, by the strings' order, so suffixes are
    compared within their strings.  The first key packs as many letters as 63
    bits hold, the later ones the ranks of two or three places each, so that few
    sorts reach the longest string, and only suffixes that are still equal to
    others are sorted again; equal rests keep the order of their strings.
    """
    size, k = np.diff(first), len(first) - 1
    n = len(text) + k
    used = np.zeros(256, bool)
    used[text] = True
    rank = np.zeros(n, np.int64)  # 0: a separator
    rank[np.arange(len(text)) + np.repeat(np.arange(k), size)] = np.cumsum(used)[text]
    rest = np.repeat((first[1:] + np.arange(k)).astype(np.int32), size + 1)
    rest -= np.arange(n, dtype=np.int32)  # letters before the string's end
    longest, bits = int(size.max(initial=0)) + 1, max(int(used.sum()).bit_length(), 1)
    parts = min(63 // bits, longest)
    key = rank.copy()
    for at in range(1, parts):
        key <<= bits
        key[: n - at] |= np.where(rest[: n - at] >= at, rank[at:], 0)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key, width, bits = key[order], parts, max((n - 1).bit_length(), 1)
    places, who = np.arange(n, dtype=np.int32), order
    while width < longest:
        new = np.r_[True, key[1:] != key[:-1]]
        rank[who] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the first place of equal suffixes
        # Suffixes that are alone, or end within the letters compared, have found their place.
        more = np.flatnonzero(~(new & np.r_[new[1:], True]))
        more = more[rest[who[more]] >= width]
        if not len(more):
            break
        places, who = places[more], who[more]
        parts = min(63 // bits, -(-longest // width))
        key, left = rank[who], rest[who]
        for i in range(1, parts):
            at = i * width
            key = (key << bits) | np.where(left >= at, rank[np.minimum(who + at, n - 1)], 0)
        by = np.argsort(key, kind="stable")
        key, who = key[by], who[by]
        order[places] = who
        width *= parts
    return order


class RunLengthIndex:
    def __init__(self, text: np.ndarray, first: np.ndarray, owner: np.ndarray, cap: int) -> None:
        """Strings text[first[k]:first[k + 1]] with owners (smaller ones count as earlier)."""
        size, k = np.diff(first), len(first) - 1
        self.cap, self.count = cap, k
        at = np.arange(len(text)) + np.repeat(np.arange(k), size)
        n = len(text) + k
        self.symbols = np.empty(n, np.int32)  # separators 0 to k - 1, then bytes
        self.symbols[at] = text.astype(np.int32) + k
        self.symbols[first[1:] + np.arange(k)] = np.arange(k)
        order = suffix_order(text, first)
        letter = np.maximum(self.symbols[order - 1] - k, -1).astype(np.int16)  # before each suffix; -1: a separator
        new = np.r_[True, letter[1:] != letter[:-1]]
        self.start = np.flatnonzero(new).astype(np.int32)
        self.run_of = (np.cumsum(new) - 1).astype(np.int32)  # the run of each row
        stop = np.r_[self.start[1:], np.int32(n)]
        self.letter = letter[self.start]
        length = stop - self.start
        by = np.argsort(self.letter, kind="stable")
        before = np.cumsum(length[by]) - length[by]
        runs_of = np.bincount(self.letter + 1, minlength=257)  # by letter + 1
        group = np.repeat(np.cumsum(runs_of) - runs_of, runs_of)
        counted = np.empty(len(by), np.int64)
        counted[by] = before - before[group]
        smaller = np.r_[0, np.cumsum(np.bincount(letter + 1, minlength=257))]
        del letter, at
        self.shift = smaller[self.letter + 1] + counted - self.start  # LF mapping: row + shift of its run
        self.first_place, self.last_place = order[self.start], order[stop - 1]
        self.last_row = stop - 1
        self.keys = (self.letter[by].astype(np.int64) + 1) * len(by) + by
        # Classes: rows that agree in their first `cap` bytes.
        h = np.zeros(n, np.uint64)
        if n > cap:
            h[: n - cap] = sums_windows(prefix_sums(mix64(self.symbols.astype(np.uint64) + np.uint64(7))), cap)[: n - cap]
            h[n - cap :] = np.arange(cap, dtype=np.uint64)
        h = h[order]
        new = np.r_[True, h[1:] != h[:-1]]
        self.class_of = (np.cumsum(new) - 1).astype(np.int32)  # the class of each row
        del h
        place_owner = np.repeat(owner, size + 1)[order]
        self.class_owner = np.minimum.reduceat(place_owner, np.flatnonzero(new))

    def shared(self, patterns: np.ndarray, who: np.ndarray, at: int, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bytes (up to cap) that patterns[who] from column ``at`` share with the text at ``place``."""
        width = min(self.cap, patterns.shape[1] - at)
        if width <= 0:
            return np.zeros(len(who), np.int64)
        column = at + np.arange(width)
        own = patterns[who[:, None], column[None, :]] + self.count
        own[column[None, :] >= ends[who][:, None]] = -1
        spot = place[:, None] + np.arange(width)[None, :]
        text = np.where(spot < len(self.symbols), self.symbols[np.minimum(spot, len(self.symbols) - 1)], -2)
        differ = own != text
        return np.where(differ.any(axis=1), differ.argmax(axis=1), width)

    def stream(self, patterns: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics (up to cap) and, at full matches, the class's smallest owner.

        ``patterns`` is a matrix of byte values, one pattern a row, of which the
        first ``ends`` columns count.  Owners are -1 where the match is shorter.
        """
        m, width = patterns.shape
        columns = np.ascontiguousarray(patterns.T, np.int16)
        patterns = patterns.astype(np.int32)
        lengths, owners = np.zeros((width, m), np.int64), np.full((width, m), -1, np.int64)
        row, place, have = np.zeros(m, np.int64), np.full(m, self.first_place[0]), np.zeros(m, np.int64)
        total = len(self.letter)
        for at in range(width - 1, -1, -1):
            who = np.flatnonzero(ends > at)
            letter = columns[at, who]
            r, p, shares = row[who], place[who], have[who]
            run = self.run_of[r]
            fits = self.letter[run] == letter
            miss = np.flatnonzero(~fits)
            if len(miss):
                w = who[miss]
                wanted = letter[miss].astype(np.int64) + 1
                key = wanted * total + run[miss]
                spot = np.searchsorted(self.keys, key)
                below = self.keys[np.minimum(spot, total - 1)]
                above = self.keys[np.maximum(spot - 1, 0)]
                has_below = (spot < total) & (below // total == wanted)
                has_above = (spot > 0) & (above // total == wanted)
                down, up = np.where(has_below, below % total, 0), np.where(has_above, above % total, 0)
                with_down = np.where(has_below, self.shared(patterns, w, at + 1, ends, self.first_place[down]), -1)
                with_up = np.where(has_above, self.shared(patterns, w, at + 1, ends, self.last_place[up]), -1)
                choose = with_down >= with_up
                best = np.maximum(with_down, with_up)
                found = best >= 0
                run[miss] = np.where(found, np.where(choose, down, up), run[miss])
                r[miss] = np.where(found, np.where(choose, self.start[down], self.last_row[up]), r[miss])
                p[miss] = np.where(found, np.where(choose, self.first_place[down], self.last_place[up]), p[miss])
                shares[miss] = np.where(found, best, -1)  # -1: the letter does not occur
                fits[miss] = found
            r += np.where(fits, self.shift[run], 0)
            p -= fits
            shares = np.minimum(shares + 1, self.cap)
            row[who], place[who], have[who] = r, p, shares
            lengths[at, who] = shares
            full = np.flatnonzero(shares >= self.cap)
            owners[at, who[full]] = self.class_owner[self.class_of[r[full]]]
        return lengths.T, owners.T
