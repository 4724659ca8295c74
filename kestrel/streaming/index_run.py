"""Incremental index runs: a stream over a growing container of documents, with a ledger of finished batches.

A micro-batch writes its chunks and the keys of its documents under its own id, overwriting what an
earlier attempt left, and then its line in the ledger.  Readers see batches of the ledger only, so a
batch that was cut off is not seen, and one that is run again replaces its own rows and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.text import base64url
from kestrel.operators.enrich import index_projection


def latest_arrivals(docs: DataFrame, order_col: str) -> DataFrame:
    """One row per ``source_url``: the last by ``order_col``, of equal ones that of the largest content hash.  A
    combinable ``max_by``, so a document that arrives very often costs one partial row a task.  Rows without a URL go."""
    order = F.struct(F.col(order_col), F.coalesce(F.sha2("content", 256), F.lit("")))
    last = F.max_by(F.struct("content", "file_name"), order).alias("last")
    return docs.where(F.col("source_url").isNotNull()).groupBy("source_url").agg(last).select("last.content", "last.file_name", "source_url")


def apply_batch(docs: DataFrame, batch_id: int, path: str, order_col: str, project: Callable[[DataFrame], DataFrame] = index_projection) -> None:
    """Index the documents ``(content, file_name, source_url, order_col)`` of one batch into ``path``.

    A document replaces all chunks that earlier batches made of its URL.  Null or blank content leaves it
    without chunks, which is how a document is deleted."""
    spark = docs.sparkSession
    last = latest_arrivals(docs, order_col)
    keys = docs.where(F.col("source_url").isNotNull()).select(base64url(F.col("source_url")).alias("parent_id")).distinct()
    project(last).write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
    keys.write.mode("overwrite").parquet(f"{path}/parents/batch={batch_id}")
    n_docs = spark.read.parquet(f"{path}/parents/batch={batch_id}").count()
    n_chunks = spark.read.parquet(f"{path}/chunks/batch={batch_id}").count()
    line = spark.range(1).select(F.lit(n_docs).alias("n_documents"), F.lit(n_chunks).alias("n_chunks"))
    line.write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")


def run_index(stream: DataFrame, path: str, checkpoint: str, order_col: str, project: Callable[[DataFrame], DataFrame] = index_projection) -> None:
    """Index everything that has arrived since the last run with this ``checkpoint``, then stop.  Batch ids go on
    from run to run; a later batch wins over an earlier one."""
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda docs, batch_id: apply_batch(docs, batch_id, path, order_col, project))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``batch, n_documents, n_chunks`` of every finished batch.  Raises where no batch was ever finished."""
    return spark.read.parquet(f"{path}/ledger").select("batch", "n_documents", "n_chunks")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each document's last finished batch.  Two joins: batches with the ledger, and chunks with
    the (document, batch) pairs that count; ``index_write`` of the result gives a plain index."""
    done = ledger(spark, path).select("batch")
    parents = spark.read.parquet(f"{path}/parents").join(done, "batch", "left_semi")
    counts = parents.groupBy("parent_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/chunks").join(counts, ["parent_id", "batch"], "left_semi").drop("batch")
