"""Registered queries of the llm operators: each reads its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import (
    hash_forest, histogram_topk, language_id, license_scan, line_quality, merkle_manifest, packing, piece_codec, simhash, source_mixing, token_alignment,
    token_counts,
)
from kestrel.llm.common import bounded_batches, read

MAX_TOKENS = 2048


def tokenizer() -> dict:
    """Places of the byte-level BPE vocabulary: the tokenizer file, and the same vocabulary as ranks."""
    import public_tokenizers as public

    return {"path": public.path("byte_bpe_50k.json"), "ranks_path": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return hash_forest.nearest(rows, rows.filter("vec_id % 20 = 0"), 20)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer()["path"], 1024)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op4_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return histogram_topk.top_k(rows, rows.filter("vec_id % 50 = 0"), 5, scale=256)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return language_id.identify(read(spark, sf_dir, "documents"), fold=2, folds=4)


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack_tightly(read(spark, sf_dir, "documents"), capacity=MAX_TOKENS, end_id=0, **tokenizer())


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(read(spark, sf_dir, "documents"))


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return line_quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3, fold=0, folds=5)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op10_packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.packed_matrix(read(spark, sf_dir, "documents"), capacity=MAX_TOKENS, end_id=0, pad_id=0, width=2, **tokenizer())


def pieces_model() -> str:
    """Place of the SentencePiece BPE model."""
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def op11_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return piece_codec.digests(piece_codec.encode_and_decode(read(spark, sf_dir, "documents"), pieces_model(), add_end=True))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return token_alignment.align_tokenizers(read(spark, sf_dir, "documents"), tokenizer()["path"], pieces_model())


QUERIES = {f.__name__: f for f in (
    op1_hash_prefix_forest, op2_token_counts, op3_simhash_near_dedup, op4_histogram_topk, op5_language_id, op6_bin_slack_packing,
    op7_temperature_mixing, op8_crf_quality, op9_license_scan, op10_packed_matrix,
    op11_sentencepiece_codec, op12_merkle_manifest, op13_token_alignment,
)}

ORACLES = {
    "op4_histogram_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(max(list_inner_product(q.v, c.v)) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id AND len(q.v) = len(c.v) GROUP BY 1, 2
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op7_temperature_mixing": source_mixing.ORACLE_SQL,
    "op9_license_scan": license_scan.oracle_sql(),
    "op12_merkle_manifest": merkle_manifest.ORACLE_SQL,
}
