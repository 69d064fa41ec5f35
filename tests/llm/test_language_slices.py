"""Language prediction: a kept row's text crosses to Python once, and long batches in slices."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tradelens.llm import language_id
from tradelens.llm.queries import PIECE_VOCABULARY, vocabulary


def test_text_inside_a_kept_struct_gives_the_same_rows(spark, monkeypatch):
    rng = random.Random(1)
    words = ["hello", "world", "bonjour", "monde", "12", "été"]
    texts = [None, "", "  ", "42 #"] + [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    size = language_id.Pieces(vocabulary(PIECE_VOCABULARY)).size
    table = language_id._smoothed(np.random.default_rng(1).random((size + 2, 2)))
    model = language_id.LanguageModel(vocabulary(PIECE_VOCABULARY), ["aa", "bb"], table)
    apart = language_id.predict(docs, model)
    whole = docs.select(F.struct("doc_id", "text").alias("_doc"))
    ran = []
    plain = type(whole).mapInArrow
    monkeypatch.setattr(type(whole), "mapInArrow", lambda self, f, s, *a, **k: ran.append((self.columns, f)) or plain(self, f, s, *a, **k))
    inside = language_id.predict(whole, model, ["_doc"], "_doc.text")
    assert ran[0][0] == ["c0"]  # before: the text was a column beside the struct
    assert inside.select("_doc.doc_id", "_doc.text", "lang_pred", "score").sort("doc_id").collect() == (
        apart.join(docs, "doc_id").select("doc_id", "text", "lang_pred", "score").sort("doc_id").collect()
    )
    batch = pa.RecordBatch.from_pylist([{"c0": {"doc_id": i, "text": t}} for i, t in enumerate(texts)])
    out = list(ran[0][1](iter([batch])))
    assert [b.num_rows for b in out] == [500, 500, 204]  # before: one batch of all rows
