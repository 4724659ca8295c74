"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Each tree is a sorted array of long hash strings (one bit per random hyperplane).  A query finds the place
of its own string in all trees, takes the rows that share the longest prefix, and ascends all trees
together, one bit at a time, until enough different rows have been met.  Those are scored exactly.

Inner products become angles by one more component: rows get sqrt(M^2 - |x|^2), queries 0, where
M is the largest norm, so the row with the largest inner product has the smallest angle.

Every row is indexed.  The index is cut into blocks of bounded size, each with its own trees over its own rows;
queries meet the blocks in a grid.  A block's trees are sorted arrays in memory, so a group of equal
or close vectors, however large, spreads over all blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import materialize
from kestrel.llm.vector_grid import best_per_query, grid, matrix, vectors

BITS = 32  # length of a hash string
TREES = 48
SHARE = 0.6  # rows of a block that a query asks for before the ascent ends: recall 0.98 and more on unclustered vectors


def hash_strings(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Hash strings (rows, trees): BITS signs of projections as an unsigned number, first bit highest."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], trees * BITS))
    out = np.zeros((len(x), trees), np.uint64)
    weights = (1 << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    for a in range(0, len(x), 1024):
        bits = (x[a : a + 1024] @ planes > 0).reshape(-1, trees, BITS)
        out[a : a + 1024] = (bits * weights).sum(axis=2, dtype=np.uint64)
    return out


class PrefixForest:
    """Sorted hash strings of one block, per tree."""

    def __init__(self, strings: np.ndarray):
        self.order = np.argsort(strings, axis=0, kind="stable").T.copy()  # (trees, rows)
        self.sorted = np.take_along_axis(strings, self.order.T, axis=0).T.copy()

    def ranges(self, q: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree the run of rows that share the first ``level`` bits."""
        low = np.uint64(BITS - level)
        base = (q >> low) << low
        top = base + (np.uint64(1) << low) - np.uint64(1)
        lo = np.stack([np.searchsorted(s, base[:, t], "left") for t, s in enumerate(self.sorted)], axis=1)
        hi = np.stack([np.searchsorted(s, top[:, t], "right") for t, s in enumerate(self.sorted)], axis=1)
        return lo, hi

    def candidates(self, q: np.ndarray, wanted: int, starts: np.ndarray | None = None):
        """For each query the rows met by descending to the longest shared prefixes and ascending all trees
        in step until at least ``wanted`` different rows (or all) are met.  ``starts`` gives the first row of
        each id where rows of one id stand together: then different ids are counted instead."""
        n = self.order.shape[1]
        wanted = min(wanted, n if starts is None else len(starts))
        met = np.zeros((len(q), n), bool)
        todo = np.arange(len(q))
        for level in range(BITS, -1, -1):
            lo, hi = self.ranges(q[todo], level)
            # The trees' runs together bound the number of different rows: below it nothing can end.
            at = np.flatnonzero((hi - lo).sum(axis=1) >= wanted)
            if not len(at):
                continue
            for t, order in enumerate(self.order):
                size = hi[at, t] - lo[at, t]
                first = np.repeat(lo[at, t] - (np.cumsum(size) - size), size)
                met[np.repeat(todo[at], size), order[first + np.arange(len(first))]] = True
            reached = met[todo[at]]
            if starts is not None:
                reached = np.logical_or.reduceat(reached, starts, axis=1)
            ended = at[np.count_nonzero(reached, axis=1) >= wanted]
            todo = np.delete(todo, ended)
            if not len(todo):
                break
        return met


def search_cell(x: np.ndarray, ids: np.ndarray, strings: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_strings: np.ndarray, k: int, share: float) -> pd.DataFrame:
    """Best k ids of a block's candidates for each query, with exact scores: an id counts by its best row."""
    same, starts, group = np.unique(ids, return_index=True, return_inverse=True)
    repeated = len(same) < len(ids)
    if repeated:
        order = np.argsort(ids, kind="stable")
        x, ids, strings, group = x[order], ids[order], strings[order], group[order]
        starts = np.searchsorted(ids, same)
    forest = PrefixForest(strings)
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(q), 512):
        met = forest.candidates(q_strings[a : a + 512], max(4 * k, int(np.ceil(share * len(same)))), starts if repeated else None)
        # Where the batch's queries have met most rows, one matrix product costs less than gathering them.
        product = q[a : a + 512] @ x.T if met.mean() > 0.25 else None
        for row, mask in enumerate(met):
            query, own = q[a + row], q_ids[a + row]
            at = np.flatnonzero(mask)
            at = at[ids[at] != own]
            if not len(at):
                continue
            s = x[at] @ query if product is None else product[row, at]
            best = s
            if repeated:
                best = np.maximum.reduceat(s, np.flatnonzero(np.diff(group[at], prepend=-1)))
            if len(best) > k:
                least = np.partition(best, len(best) - k)[len(best) - k]
                near = s >= least - 1e-9 * max(1.0, abs(least))
                at, s = at[near], s[near]
            s = (x[at] * query).sum(axis=1)  # summed alike wherever a row lies, so equal vectors tie
            top = np.lexsort((ids[at], -s))
            if repeated:  # the first place of each id
                top = top[np.sort(np.unique(ids[at[top]], return_index=True)[1])]
            top = top[:k]
            out_q.append(np.full(len(top), own))
            out_v.append(ids[at[top]])
            out_s.append(s[top])
    if not out_q:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def nearest(index: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, share: float = SHARE, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k rows of ``index`` with the largest inner
    product among those the forest meets, never the row with the query's own id; ties to the smaller id.

    Rows with a null id or a vector that is null, empty, zero, or has null or non-finite components take no
    part.  Only vectors of equal length meet.  An id with several vectors, in ``index`` or in ``queries``, is
    one candidate or one query: its score is the best of any of its vectors.  Other columns are ignored; empty tables give an empty result.
    """
    rows = materialize(vectors(index, vec_id, vector, False).dropDuplicates(["vec_id", "v"]), "forest-rows")
    asked = materialize(vectors(queries, vec_id, vector, False).dropDuplicates(["vec_id", "v"]), "forest-queries")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = rows.agg(F.max(norm).alias("m")).first()["m"] or 0.0

    def strings(batches):
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = matrix(part["v"])
                more = np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1))) if "own" not in part else np.zeros(len(x))
                h = hash_strings(np.hstack([x, more[:, None]]), trees, seed)
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": list(x), "dim": dim, "h": [r.astype("<u8").tobytes() for r in h]})

    kind = "vec_id long, v array<double>, dim int, h binary"
    hashed = rows.mapInPandas(strings, kind)
    hashed_q = asked.withColumn("own", F.lit(1)).mapInPandas(strings, kind)
    left, right = grid(hashed, hashed_q, counts=(rows.count(), asked.count()))

    def cell(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

        def unpack(d):
            return matrix(d["v"]), d["vec_id"].to_numpy(np.int64), np.stack([np.frombuffer(h, "<u8") for h in d["h"]])

        return search_cell(*unpack(l), *unpack(r), k, share)

    keys = ["dim", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double")
    # A cell gives k ids for each vector of a query; over its vectors (and dims) an id counts by its best score.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best_per_query(found, k)
