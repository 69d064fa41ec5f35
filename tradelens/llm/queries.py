"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm import (
    bpe,
    fill_in_middle,
    hard_negatives,
    hmm_lm,
    jaccard_join,
    language_id,
    merkle,
    mixing,
    piece_bpe,
    repeated_windows,
    robust_quality,
    substring_dedup,
    token_counts,
)
from tradelens.llm.flat import documents

Query = Callable[[SparkSession, str], DataFrame]

WORD_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 2048


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_quality.robust_quality(documents(spark, sf_dir)).drop("grp")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(documents(spark, sf_dir), vocabulary(WORD_VOCABULARY))
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) DIV 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(documents(spark, sf_dir))


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(documents(spark, sf_dir), language_id.crc_remainder(7) == 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(language_id.crc_remainder(4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out), vocabulary(PIECE_VOCABULARY))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(documents(spark, sf_dir), vocabulary(WORD_VOCABULARY))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document, half way from the sources' own entropy to equal shares, at the corpus's own token count."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    mix = mixing.plan_mix(docs, flatten=0.5, budget_tokens=0)
    out = mixing.apply_mix(docs.withColumn("n_tokens", mixing.word_tokens()).drop("text"), mix)
    return out.select("doc_id", "source", "n_tokens", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_order").alias("block_order"))


def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_windows.remove_repeated(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.restore(fill_in_middle.fill_in_middle(documents(spark, sf_dir)))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_bpe.encode_decode(documents(spark, sf_dir), vocabulary(PIECE_VOCABULARY))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every hundredth id; every seventh id's label moves on by one."""
    moved = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    rows = hard_negatives.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_robust_quality,
            op2_substring_dedup,
            op3_bpe,
            op4_merkle,
            op5_hmm_lm,
            op6_language_id,
            op7_token_counts,
            op8_jaccard_join,
            op9_mixing,
            op10_repeated_windows,
            op11_fill_in_middle,
            op12_piece_bpe,
            op13_hard_negatives,
        )
    }


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op8_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [hash(array_to_string(ws, ' '))]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: hash(array_to_string(ws[i:i + 3], ' ')))) END AS items FROM words
), each AS (
  SELECT doc_id, len(items) AS n, unnest(items) AS item FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM each a JOIN each b ON a.item = b.item AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON l.x = r.y
)
SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.items)""",
    "op10_repeated_windows": rf"""
WITH words AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i,
    unnest(list_transform(range(1, len(ws) - 33), lambda i: array_to_string(ws[i:i + 34], ' '))) AS win
  FROM words WHERE len(ws) >= 35
), often AS (
  SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM windows WHERE win IN (SELECT win FROM often)
), each AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS w FROM words
), rest AS (
  SELECT e.doc_id, string_agg(e.w, ' ' ORDER BY e.j) AS kept, count(*) AS n FROM each e
  ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY e.doc_id
)
SELECT words.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN rest ON rest.doc_id = words.doc_id""",
    "op11_fill_in_middle": r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || doc_id) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, substr(t, 1, least(a, b)) AS pre, substr(t, least(a, b) + 1, abs(a - b)) AS mid, substr(t, greatest(a, b) + 1) AS suf FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut""",
    "op13_hard_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
