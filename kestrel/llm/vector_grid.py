"""Blocks of vectors: a stated query set against all rows, dealt out as a grid of bounded cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a cell side; with 8 bytes a component a side of 1,000 components stays below 70 MB.
INDEX_ROWS = 8192
QUERY_ROWS = 2048


def usable(vector: str, allow_zero: bool) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & fine
    if not allow_zero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def vectors(df: DataFrame, vec_id: str, vector: str, allow_zero: bool) -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that take part."""
    kept = df.filter(F.col(vec_id).isNotNull() & usable(vector, allow_zero))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).withColumn("dim", F.size("v"))


def grid(
    index: DataFrame, queries: DataFrame, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS, counts: tuple[int, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides with cell columns i (index block), j (query block).

    Index rows are hashed to blocks of about ``index_rows`` and copied to each query block, queries the other
    way round, so each cell holds a bounded number of rows of either side.  ``counts`` gives the numbers of
    rows where they are known.
    """
    n_index, n_queries = counts or (index.count(), queries.count())
    n_i, n_j = max(1, -(-n_index // index_rows)), max(1, -(-n_queries // query_rows))
    i = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_i)).cast("int").alias("i")
    j = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_j)).cast("int").alias("j")
    left = index.select("*", i, F.explode(F.sequence(F.lit(0), F.lit(n_j - 1))).alias("j"))
    right = queries.select("*", j, F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))).alias("i"))
    return left, right


def matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col])


def best_per_query(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller vec_id."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
