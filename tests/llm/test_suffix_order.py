"""Suffix order of short strings: against plain sorting, and in few sorts."""

from __future__ import annotations

import random

import numpy as np

from tradelens.llm import run_index


def _flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])


def _plain(strings: list[bytes]) -> list[int]:
    k, first = len(strings), np.cumsum([0, *[len(s) + 1 for s in strings]])
    rows = [([c + k for c in s[i:]] + [j], int(first[j]) + i) for j, s in enumerate(strings) for i in range(len(s) + 1)]
    return [at for _, at in sorted(rows)]


def test_suffix_order_equals_plain_sorting():
    rng = random.Random(3)
    for letters in (b"a", b"ab", bytes(range(256))):
        for longest in (1, 7, 8, 76, 300):
            strings = [bytes(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(12)] + [b"", b"\x00\x00", letters[:9]]
            strings += strings[:4]
            assert run_index.suffix_order(*_flat(strings)).tolist() == _plain(strings)
    assert run_index.suffix_order(*_flat([b"", b""])).tolist() == [0, 1]


def test_copies_take_few_sorts(monkeypatch):
    sorts = []
    plain = np.argsort
    monkeypatch.setattr(run_index.np, "argsort", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    text = bytes(random.Random(5).choices(range(32, 127), k=76))
    text, first = _flat([text] * 200)
    run_index.RunLengthIndex(text, first, np.arange(200), 50)
    assert len(sorts) <= 5  # prefix doubling from one letter took eight
