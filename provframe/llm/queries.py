"""The corpus operators as queries over the given tables: (spark, folder) to DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provframe.llm import alignment, bpe, exact_dedup, hard_negatives, html_extract, packing, pii, piece_bpe, quality_classifier, quality_rules, simhash, substring_dedup, toxicity
from provframe.llm.common import read_table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded(read_table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, digests=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(read_table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(read_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.coded(read_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECES)


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.coded(read_table(spark, sf_dir, "documents"), PIECES, digests=True)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(read_table(spark, sf_dir, "embeddings"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""

OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor, anchor_id, id, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place
  FROM scored WHERE same
  QUALIFY place <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.id)
QUALIFY rank <= 10
"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_html": op7_html,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_alignment": op11_alignment,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {"op8_exact_dedup": OP8_SQL, "op13_hard_negatives": OP13_SQL}
