"""A pair with many common prefix cells is proposed in few of them, and no link is lost, also where cells are split."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tradelens.llm import jaccard_join


def plain(rows, width, percent):
    sets = {k: {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} for k, t in rows if (w := t.split())}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("cell", [2000, 5])
def test_components_of_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    rng = random.Random(cell)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join_components(df).collect()}
    assert got == plain(rows, 4, 85)


def test_met_before():
    cell = np.array([5, 5, 5, 5, 9])
    a = np.array([[1, 5], [2, 5], [5, 7], [6, 8], [3, 9]])
    b = np.array([[1, 9], [3, 5], [5, 7], [6, 8], [2, 3]])
    assert jaccard_join.met_before(cell, a, b).tolist() == [True, False, False, False, True]
