"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(k) for k in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def substring(docs, width=50):
    low = {}
    for k, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            low[b[i : i + width]] = min(low.get(b[i : i + width], LAST), LAST if k is None else k)
    out = []
    for k, t in docs:
        b, key = (t or "").encode(), LAST if k is None else k
        gone = {j for i in range(len(b) - width + 1) if low[b[i : i + width]] < key for j in range(i, i + width)}
        spans = sum(1 for j in gone if j - 1 not in gone)
        out.append((k, len(b), len(gone), spans, bytes(x for j, x in enumerate(b) if j not in gone)))
    return sorted(out, key=str)


def windows(docs, width):
    words = [(k, (t or "").encode().split()) for k, t in docs]
    c = Counter(tuple(w[i : i + width]) for _, w in words for i in range(len(w) - width + 1))
    out = []
    for k, w in words:
        gone = {j for i in range(len(w) - width + 1) if c[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((k, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def components(docs, percent=85):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in seen[x])
        for x in s:
            seen[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(docs):
        low[find(i)] = min([x for x in (low.get(find(i)), k) if x is not None], default=None)
    return sorted([(k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(docs)], key=str)
