"""Token counts by batch encoding inside Arrow functions (lengths only).

Texts are packed into batches of about equal bytes; a long text is split at
safe boundaries, so memory follows the batch size, not the longest text, and
the pieces' lengths sum to the length of the whole.

ASCII white space is a safe boundary for vocabularies whose pattern drops it
and never crosses it: no added token contains any, and no composition reaches
over it.  Each distinct chunk between such boundaries is encoded once per
batch and remembered.  A sentencepiece model keeps white space in its pieces,
so its texts are encoded whole.

Null text counts as empty; empty tables give empty results; repeated rows give
one row each; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.flat import id_text

SAFE_SPACE = re.compile(rb"[ \t-\r]")
#: Distinct chunks remembered by a task before its cache starts anew, and the longest one kept.
CACHE_CHUNKS, CACHE_BYTES = 400_000, 64


def split_safely(text: bytes, limit: int) -> list[bytes]:
    """Pieces of about ``limit`` bytes whose token counts sum to the text's."""
    pieces, at = [], 0
    while len(text) - at > limit:
        cut = SAFE_SPACE.search(text, at + limit)
        if cut is None:
            break
        pieces.append(text[at : cut.end()])
        at = cut.end()
    pieces.append(text[at:])
    return pieces


def byte_batches(texts: list[bytes], batch_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """(row, piece) batches of about equal size."""
    batch: list[tuple[int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for piece in split_safely(text, batch_bytes) if len(text) > batch_bytes else (text,):
            if batch and size + len(piece) > batch_bytes:
                yield batch
                batch, size = [], 0
            batch.append((row, piece))
            size += len(piece)
    if batch:
        yield batch


def token_counts(docs: DataFrame, vocabulary: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text.

    ``vocabulary`` is the path of a tokenizers .json or sentencepiece .model
    file, present on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = vocabulary.endswith(".model")
        if whole:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(vocabulary)
            tokenizer.no_truncation()
            tokenizer.no_padding()
        known: dict[bytes, int] = {}

        def lengths(texts: list[bytes]) -> list[int]:
            got = [t.decode("utf-8", "replace") for t in texts]
            if whole:
                return [len(x) for x in model.encode(got, num_threads=1)]
            return [len(x) for x in tokenizer.encode_batch_fast(got, add_special_tokens=False)]

        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            n = [0] * len(texts)
            if whole:
                n = [lengths([t])[0] for t in texts]
                texts = []
            for batch in byte_batches(texts, batch_bytes):
                if len(known) > CACHE_CHUNKS:
                    known = {}
                split = [piece.split() for _, piece in batch]
                new = list(set().union(*split).difference(known))
                known.update(zip(new, lengths(new), strict=True))
                for (row, _), chunks in zip(batch, split, strict=True):
                    n[row] += sum(map(known.__getitem__, chunks))
                for long in [c for c in new if len(c) > CACHE_BYTES]:
                    del known[long]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = id_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
