"""Fill-in-middle, merge-type encoding and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelens.llm import fill_in_middle, hard_negatives, piece_bpe, queries

SCHEMA = "doc_id long, text string, lang string, n long, form string, ids string, output string, restored string, h1 long, marked int"


def table(spark, docs):
    return spark.createDataFrame([(k, t, "en", 1, "psm", "x", "y", "z", 5, 6) for k, t in docs], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    letters = ["a", "b", " ", "\n", "é", "日", "𠮷", "<", "P", ">", "▁", "\t", "\x00", "́", "the "]
    out = [(0, None), (1, ""), (2, " "), (3, "<P>"), (4, "a<S>b"), (5, "< P><M"), (None, "no id"), (7, "x" * 300_000 + " " + "日本 " * 400_000)]
    out += [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(8, 400)]
    return [*out, (50, "again"), (50, "again")]


def plain_fill(doc_id, text):
    """The contract, word by word."""
    t = text or ""
    n = len(t)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m
    return doc_id, n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m


def test_fill_in_middle(spark, docs):
    made = fill_in_middle.fill_in_middle(table(spark, docs))
    rows = fill_in_middle.restore(made).collect()
    got = sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in rows], key=str)
    assert got == sorted([plain_fill(k, t) for k, t in docs], key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    texts = sorted([(k, t or "") for k, t in docs], key=str)
    assert sorted([(r.doc_id, bytes(r.restored).decode()) for r in rows], key=str) == texts
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, docs).limit(0))).count() == 0


def test_fill_in_middle_parameters(spark, docs):
    few = table(spark, docs[8:200])
    assert {r.form for r in fill_in_middle.fill_in_middle(few, percent=0).collect()} == {"plain"}
    assert "psm" not in {r.form for r in fill_in_middle.fill_in_middle(few, spm_percent=100).collect()}
    marks = ("[pre]", "[suf]", "[mid]")
    made = fill_in_middle.fill_in_middle(few, marks=marks, seed=9)
    rows = fill_in_middle.restore(made, marks=marks).collect()
    assert sorted([(r.doc_id, bytes(r.restored).decode()) for r in rows]) == sorted((k, t) for k, t in docs[8:200])
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(few, marks=("<P>", "<S>", "|M|"))


def test_scatter_and_gather_every_cut():
    marks = fill_in_middle._mark_bytes(fill_in_middle.MARKS)
    texts = ["aé", "", "<x", "日", "S>", "ab"]
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for first in range(3):
        for second in range(first, 3):
            cuts = np.array([[min(first, len(t)), min(second, len(t))] for t in texts])
            n, places = fill_in_middle.cut_places(buf, offsets, cuts)
            assert n.tolist() == [len(t) for t in texts]
            order = np.array([(0, 1, 2), (-1, -1, -1), (1, 0, 2), (0, 1, 2), (-1, -1, -1), (1, 0, 2)])
            out, ends = fill_in_middle.scatter(buf, offsets, places, order, marks)
            for i, t in enumerate(texts):
                a, b = cuts[i]
                want = {0: f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", 1: f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", -1: t}[order[i, 0]]
                assert out[ends[i] : ends[i + 1]].tobytes().decode() == want
            back, back_offsets = fill_in_middle.gather(out, ends, order, marks)
            assert back.tobytes() == buf.tobytes() and back_offsets.tolist() == offsets.tolist()


def library():
    import sentencepiece

    path = queries.vocabulary(queries.PIECE_VOCABULARY)
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_piece_bpe_matches_the_library(spark, docs):
    path, model = library()
    got = sorted([(r.doc_id, r.ids, r.decoded) for r in piece_bpe.encode_decode(table(spark, docs), path).collect()], key=str)
    want = [(k, model.encode(t or "")) for k, t in docs]
    assert got == sorted([(k, ids, model.decode(ids)) for k, ids in want], key=str)
    assert piece_bpe.encode_decode(table(spark, docs).limit(0), path).count() == 0


def test_backtracking_against_the_library_and_the_merges():
    path, model = library()
    bpe = piece_bpe.PieceBpe(path)
    rng = random.Random(3)
    pieces = list(bpe.score)
    texts = [" " * k for k in range(120)] + ["x" + "▁" * k + "the" for k in range(60)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcehinst") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    ids, first = bpe.encode_batch(texts)
    text, ends = bpe.decode_batch(ids, first)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == model.encode(t)
        assert text[ends[i] : ends[i + 1]].tobytes().decode() == model.decode(model.encode(t))
    for t in texts[-300:]:
        longest = bpe.longest_at(t + bpe.wall)
        assert [bpe.text_of[s] for s in bpe.backtrack(longest, 0, len(t))] == bpe.merged(t)


def test_small_caches_and_batches(monkeypatch, docs):
    path, model = library()
    monkeypatch.setattr(piece_bpe, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(piece_bpe, "CACHE_PAIRS", 3)
    monkeypatch.setattr(piece_bpe, "CACHE_LENGTH", 2)
    bpe = piece_bpe.PieceBpe(path)
    for _, t in docs[8:200]:
        assert bpe.encode_batch([t])[0].tolist() == model.encode(t)


def plain_mine(rows, n_positives=5, n_negatives=10, window=(30, 90)):
    """All pairs of (vec_id, label, integer vector) rows."""
    rows = list({(i, y, v) for i, y, v in rows})
    out = []
    for anchor, label, q in rows:
        if anchor % 100:
            continue
        score = {r: sum(a * b for a, b in zip(q, r[2], strict=False)) for r in rows}
        same = sorted((-score[r], r[0]) for r in rows if r[1] == label and r[0] != anchor)[:n_positives]
        for ps, positive in same:
            ps = -ps
            ok = [(-score[r], r[0]) for r in rows if r[1] != label and window[0] * ps <= 100 * score[r] <= window[1] * ps]
            out += [(anchor, positive, k + 1, i, ps, -s) for k, (s, i) in enumerate(sorted(ok)[:n_negatives])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, ids string, block int, score long")
    out = hard_negatives.mine(hard_negatives.quantised(df), F.col("vec_id") % 100 == 0, **more)
    return sorted(tuple(r) for r in out.collect())


def integer_rows(rows):
    ok = [r for r in rows if None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], r[2], tuple(math.floor(256 * x) for x in r[1])) for r in ok]


@pytest.mark.parametrize("blocks", [(4096, 1024), (16, 1)])
def test_hard_negatives(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[1])
    rng = random.Random(8)
    # Short components make ties; a hot vector holds a third of the rows; rows that take no part.
    vectors = [[rng.choice([-0.5, -0.01, 0.0, 0.25, 0.7]) for _ in range(5)] for _ in range(60)]
    ids = [*range(0, 300, 100), *rng.sample(range(1, 5000), 177)]
    rows = [(i, vectors[0] if rng.random() < 0.33 else rng.choice(vectors), rng.randint(0, 2), "x", 1, 2) for i in ids]
    rows += [(100, [], None, "x", 1, 2), (200, None, 1, "x", 1, 2), (300, [1.0, None, 0.0, 0.0, 0.0], 1, "x", 1, 2), (None, vectors[1], 1, "x", 1, 2)]
    rows += [(400, [math.nan, 1.0, 1.0, 1.0, 1.0], 0, "x", 1, 2), (500, [math.inf, 1.0, 1.0, 1.0, 1.0], 0, "x", 1, 2), rows[0], rows[0]]
    rows += [(600, [0.0] * 5, 1, "x", 1, 2), (700, [], 2, "x", 1, 2), (801, [0.5, 0.5], 2, "x", 1, 2)]
    rows += [(900, [0.7, 0.7, 0.25, 0.25, k / 8], 1, "x", 1, 2) for k in range(8)]  # one id, many vectors
    got = mined(spark, rows)
    assert got == plain_mine(integer_rows(rows)) and len(got) > 50
    assert mined(spark, rows[:3]) == plain_mine(integer_rows(rows[:3]))
    assert mined(spark, [r for r in rows if r[2] is None]) == []


def test_cover_tree_skips_nodes_and_keeps_its_promises():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32)) * 100
    points = np.floor(centres[rng.integers(40, size=2000)] + rng.normal(size=(2000, 32)) * 5).astype(np.int64)
    tree = hard_negatives.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(2000))
    norms = (points.astype(float) ** 2).sum(axis=1)
    vectors, blur = np.c_[points, np.sqrt(norms.max() - norms)], 1e-6 * math.sqrt(norms.max())

    def below(node):
        a, b = tree.bucket[node]
        return [*tree.order[a:b], *(x for c in tree.children[node] for x in below(c))]

    for node, children in enumerate(tree.children):
        rows = below(node)
        far = np.linalg.norm(vectors[rows] - vectors[tree.centre[node]], axis=1)
        assert far.max() <= tree.reach[node]  # covering
        for x in children:
            assert tree.reach[x] <= tree.reach[node] / hard_negatives.BASE + blur
            for y in children:
                apart = np.linalg.norm(vectors[tree.centre[x]] - vectors[tree.centre[y]])
                assert x == y or apart > tree.reach[node] / hard_negatives.BASE - blur  # separation
    ids, wanted = [[i] for i in range(2000)], rng.random(2000) < 0.8
    for i in range(50):
        scores = points @ points[i]
        windows = [(-math.inf, math.inf), (int(0.3 * scores[i]), int(0.9 * scores[i])), (int(0.5 * scores[i]), int(0.6 * scores[i]))]
        wants = [sorted((-int(s), j) for j, s in enumerate(scores) if wanted[j] and low <= s <= high and j != i)[:7] for low, high in windows]
        for asked, want in (windows, wants), (windows[:1], wants[:1]):
            got, verified = tree.search(points[i], wanted & (np.arange(2000) != i), ids, 7, asked, i)
            assert [[(-s, j) for s, j in one] for one in got] == want
        assert verified < 400  # most leaves are never opened


def test_cover_tree_large_components_and_overflow():
    points = np.array([[3 * 10**9, 1], [10**9, -5], [-(10**9), 7]], np.int64)
    tree = hard_negatives.CoverTree(points)
    got, _ = tree.search(np.array([10**9, 10**9 // 3]), np.ones(3, bool), [[1], [2], [3]], 3, [(-math.inf, math.inf)])
    assert got[0] == sorted([(int(p[0]) * 10**9 + int(p[1]) * (10**9 // 3), i + 1) for i, p in enumerate(points)], reverse=True)
    with pytest.raises(ArithmeticError):
        tree.search(np.array([10**18, 10**18]), np.ones(3, bool), [[1], [2], [3]], 3, [(-math.inf, math.inf)])
