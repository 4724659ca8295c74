"""Exact top-k by inner product: distributed histogram selection.

Every query scores every row, in bounded cells.  A round counts the scores of each query in equal bins of a
range that is known to hold its k-th highest score; the counts of all cells are added up, the bin
that holds the k-th score becomes the next range, until the range is a single score.  Then the rows
at or above that score are filtered and ties go to the smaller id.

A cell sends only its highest non-empty bins until they hold k scores: the k-th score of a part is never above
that of the whole, so no lower bin of the cell can matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import materialize
from kestrel.llm.vector_grid import best_per_query, grid, matrix, vectors

BINS = 512
EXACT = 1 << 53


def score_matrix(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products (queries, rows); in double precision where that is exact, else in 64-bit integers."""
    bound = x.shape[1] * np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0)
    if bound < EXACT:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def top_k(index: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score (long): for each row of ``queries`` the k rows of ``index`` with the highest
    inner product of the vectors floor(scale * x), never the row with the query's own id; ties to the
    smaller id.

    Rows with a null id or a vector that is null, empty, or has null or non-finite components take no part
    (zero vectors do).  Only vectors of equal length meet.  An id with several vectors, in ``index`` or in
    ``queries``, is one candidate or one query: its score is the best of any of its vectors.  Scores are
    64-bit integers (values beyond wrap).
    Other columns are ignored; empty tables give an empty result.
    """
    whole = lambda df: df.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    rows = materialize(whole(vectors(index, vec_id, vector, True)).dropDuplicates(["vec_id", "v"]), "topk-rows")
    # Each vector of a query id is searched on its own (number q): the best k ids over all of them are among the best k of each.
    asked = whole(vectors(queries, vec_id, vector, True)).dropDuplicates(["vec_id", "v"])
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    far = rows.groupBy("dim").agg(F.sqrt(F.max(size)).alias("far"))  # scores lie within |q| * far
    reach = F.least(F.sqrt(size) * F.col("far") * 1.000001 + 2, F.lit(float(1 << 61))).cast("long")
    state = asked.join(far, "dim").select("q", "vec_id", "v", "dim", (-reach).alias("lo"), (2 * reach + 1).alias("width"))
    keys = ["dim", "i", "j"]

    def scores(l: pd.DataFrame, r: pd.DataFrame):
        l = l.sort_values("vec_id")
        x, q = matrix(l["v"]), matrix(r["v"])
        own = r["vec_id"].to_numpy(np.int64)
        ids, starts = np.unique(l["vec_id"].to_numpy(np.int64), return_index=True)
        for a in range(0, len(q), 64):
            s = score_matrix(x, q[a : a + 64])
            if len(ids) < len(x):  # all rows of an id lie in one block: it is counted once, by its best score
                s = np.maximum.reduceat(s, starts, axis=1)
            for row in range(len(s)):
                yield a + row, s[row][ids != own[a + row]], ids[ids != own[a + row]]

    def histogram(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not l.empty and not r.empty:
            lo, width, number = r["lo"].to_numpy(np.int64), r["width"].to_numpy(np.int64), r["q"].to_numpy(np.int64)
            for at, s, _ in scores(l, r):
                step = -(-int(width[at]) // BINS)
                above = s >= lo[at]  # at or over the end of the range: bins past the last, all of them kept
                count = np.bincount(np.minimum((s[above] - lo[at]) // step, BINS), minlength=BINS + 1)
                some = np.flatnonzero(count)[::-1]
                need = int(np.searchsorted(np.cumsum(count[some]), k)) + 1
                out.extend((number[at], int(b), int(count[b])) for b in some[:need])
        return pd.DataFrame(out, columns=["q", "bin", "n"]).astype("int64")

    def filtered(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not l.empty and not r.empty:
            lo, own = r["lo"].to_numpy(np.int64), r["vec_id"].to_numpy(np.int64)
            for at, s, ids in scores(l, r):
                keep = s >= lo[at]
                s, ids = s[keep], ids[keep]
                best = np.lexsort((ids, -s))[:k]
                out.extend(zip([own[at]] * len(best), ids[best].tolist(), s[best].tolist()))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    widest = state.agg(F.max("width").alias("w")).first()["w"] or 1
    while widest > 1:
        left, right = grid(rows, state)
        seen = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(histogram, "q long, bin long, n long")
        total = seen.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
        held = total.withColumn("upto", F.sum("n").over(down)).filter(F.col("upto") >= k)
        kth = held.groupBy("q").agg(F.max("bin").alias("bin"))
        step = F.expr(f"cast(ceil(width / {BINS}D) as long)")
        narrowed = state.join(kth, "q", "left")
        # A query with fewer than k candidates keeps them all: its range ends at the lowest score.
        state = materialize(
            narrowed.select(
                "q", "vec_id", "v", "dim",
                F.when(F.col("bin").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("bin") * step).alias("lo"),
                F.when(F.col("bin").isNull(), F.lit(1)).otherwise(step).cast("long").alias("width"),
            ), "topk-state")
        widest = state.agg(F.max("width").alias("w")).first()["w"] or 1
    left, right = grid(rows, state)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(filtered, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best_per_query(found, k)
