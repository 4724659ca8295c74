"""Exact top-k of a table of queries against an index, in a grid of bounded blocks.

Index rows and queries are each hashed to blocks; a cell (index block, query block) computes its scores as a
matrix in bounded tiles and keeps only the best of each query.  So no (query, row) pair ever becomes a
row of a DataFrame, nothing passes through the driver, and the size of a cell does not depend on the
data: a term or a vector that a third of all rows share is spread like any other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_BYTES = 64 * 1024 * 1024
SCORE_DECIMALS = 6
#: A side of a cell: at most so many bytes of what it computes with.  Blocks this large keep the copies of a row few.
SIDE_BYTES = 32 * 1024 * 1024
#: Blocks are not made smaller than this for the sake of more tasks.
LEAST_INDEX_ROWS = 4096
LEAST_QUERY_ROWS = 256


def block_counts(n_index: int, n_queries: int, index_rows: int, query_rows: int, k: int, row_bytes: int, tasks: int) -> tuple[int, int]:
    """Numbers of index and query blocks: as few as their largest sizes allow, but enough for ``tasks`` cells, split
    where that costs fewer bytes (copies of index rows, or copies of queries and their ``k`` candidates each)."""
    n_i, n_j = max(1, -(-n_index // index_rows)), max(1, -(-n_queries // query_rows))
    while n_i * n_j < tasks:
        can_i, can_j = n_index >= 2 * n_i * LEAST_INDEX_ROWS, n_queries >= 2 * n_j * LEAST_QUERY_ROWS
        if not (can_i or can_j):
            break
        if can_i and (not can_j or n_queries * n_i * (row_bytes + 24 * k) <= n_index * n_j * row_bytes):
            n_i *= 2
        else:
            n_j *= 2
    return n_i, n_j


def grid(index: DataFrame, queries: DataFrame, key_col: str, n_i: int, n_j: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell columns ``block_i`` and ``block_j`` of a grid of ``n_i`` by ``n_j`` cells."""
    i = F.pmod(F.xxhash64(key_col, F.lit("i")), F.lit(n_i)).cast("int").alias("block_i")
    j = F.pmod(F.xxhash64("query_id", F.lit("j")), F.lit(n_j)).cast("int").alias("block_j")
    left = index.select("*", i, F.explode(F.sequence(F.lit(0), F.lit(n_j - 1))).alias("block_j"))
    right = queries.select("*", j, F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))).alias("block_i"))
    return left, right


def best(scores: np.ndarray, keys: np.ndarray, k: int, order: np.ndarray) -> list[np.ndarray]:
    """Per row of ``scores`` the columns that can be among its k best: those at or above the k-th score, less
    a band of rounding; of columns that round to one score the k lowest keys (so ties stay bounded).

    ``order`` gives the columns in ascending key order; ``-inf`` marks columns that do not count.
    """
    band = 2.0 * 10.0**-SCORE_DECIMALS
    n = scores.shape[1]
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    head = max(4096, 8 * k)  # of many columns, the k-th score of the first ones is a floor that few others reach
    first = scores[:, :head] if n > 2 * head else scores
    width = first.shape[1]
    floor = np.partition(first, width - k, axis=1)[:, width - k] if width > k else np.full(len(scores), -np.inf)
    rows, columns = np.nonzero(scores >= np.maximum(floor - band, np.finfo(np.float64).min)[:, None])
    ends = np.searchsorted(rows, np.arange(len(scores) + 1))
    out = []
    for r, row in enumerate(scores):
        at = columns[ends[r] : ends[r + 1]]
        if len(at) > k:
            values = row[at]
            at = at[values >= np.partition(values, len(at) - k)[len(at) - k] - band]
        at = at[np.argsort(place[at], kind="stable")]
        if len(at) > k:  # in key order: the first k of each rounded score
            level = np.round(row[at], SCORE_DECIMALS)
            by = np.argsort(-level, kind="stable")
            new = np.concatenate(([True], np.diff(level[by]) != 0))
            since = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            at = at[by[np.arange(len(by)) - since < k]]
        out.append(at)
    return out


def leave_out_self(scores: np.ndarray, query_ids: np.ndarray, keys: np.ndarray, order: np.ndarray) -> None:
    """Marks the columns whose key is the row's own query id with ``-inf``; ``order`` sorts ``keys``."""
    if query_ids.dtype != keys.dtype:
        scores[query_ids[:, None] == keys[None, :]] = -np.inf
        return
    ordered = keys[order]
    low, high = np.searchsorted(ordered, query_ids, "left"), np.searchsorted(ordered, query_ids, "right")
    for r in np.flatnonzero(high > low):
        scores[r, order[low[r] : high[r]]] = -np.inf


def top_of_cells(
    left: DataFrame, right: DataFrame, key_col: str, k: int, scorer: Callable[[pd.DataFrame, np.ndarray], Callable[[pd.DataFrame], np.ndarray]]
) -> DataFrame:
    """(query_id, key, score) candidates: ``scorer(rows, order)`` takes the rows of a cell, and the order of their keys,
    once and gives a function from some of its queries to their score matrix."""
    key_type = left.schema[key_col].dataType.simpleString()
    query_type = right.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, {key_col} {key_type}, score double"

    def cell(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        q_out, k_out, s_out = [], [], []
        if len(rows) and len(queries):
            keys = rows[key_col].to_numpy()
            order = np.argsort(keys, kind="stable")
            q_ids = queries["query_id"].to_numpy()
            step = max(1, TILE_BYTES // (24 * len(rows)))
            score = scorer(rows, order)
            for a in range(0, len(queries), step):
                s = score(queries.iloc[a : a + step])
                for r, at in enumerate(best(s, keys, k, order)):
                    q_out.append(np.repeat(q_ids[a + r : a + r + 1], len(at)))
                    k_out.append(keys[at])
                    s_out.append(s[r, at])
        if not q_out:
            none = {c: pd.Series([], dtype="int64" if t in ("bigint", "int") else object) for c, t in (("query_id", query_type), (key_col, key_type))}
            return pd.DataFrame({**none, "score": np.zeros(0)})
        return pd.DataFrame({"query_id": np.concatenate(q_out), key_col: np.concatenate(k_out), "score": np.concatenate(s_out)})

    cells = ["block_i", "block_j"]
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(cell, schema)
