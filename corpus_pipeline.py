"""Corpus preparation: language ID, quality filter, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import language_id, line_quality, packing, simhash, source_mixing
from kestrel.llm.common import bounded_batches, free_name, materialize, read
from kestrel.llm.queries import MAX_TOKENS, tokenizer

MIN_LANGUAGE_SCORE = 0.5
MIN_QUALITY = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (null, or no letter) and those of an unsure one.

    Where no row has a language to learn from, only null texts and those without a letter go."""
    bounded_batches(spark)
    model = language_id.train(docs, fold=2, folds=4)
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    p = free_name(docs, "language")
    sure = (F.col(p)["lang"] != "und") & (F.col(p)["score"] >= MIN_LANGUAGE_SCORE)
    return docs.withColumn(p, language_id.prediction("text", model)).filter(sure).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the line classifier predicts to be of quality 0."""
    bounded_batches(spark)
    model = line_quality.train(docs, read(spark, sf_dir, "labels"), fold=0, folds=5)
    p = free_name(docs, "quality_score")
    return docs.withColumn(p, line_quality.score_column("text", model)).filter(F.col(p) >= MIN_QUALITY).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate group."""
    bounded_batches(spark)
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources as the mixture asks; none is lost."""
    return source_mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    bounded_batches(spark)
    return packing.pack_tightly(docs, capacity=MAX_TOKENS, end_id=0, **tokenizer())


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers, the fingerprints and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared scratch folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
