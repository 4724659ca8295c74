"""Approximate nearest neighbours with an inverted-file (IVF) index built from Spark ML KMeans.

* Lists: KMeans centroids, fitted on a bounded sample of the unit vectors; every vector belongs to its
  nearest centroid.
* Probing: a query visits its nearest lists, in order, until they hold ``probe_share`` of all vectors, and
  always until they hold more than ``k``; so no query gets fewer than ``k`` rows where ``k`` exist.
* Scoring: lists are put together in groups, and groups meet queries in cells ``(group, index block, query block)``
  whose numbers come from the list sizes, so a group with a list that holds a third of the index is many
  bounded blocks.  A query is sent once to each block of a group in which it has lists, with the lists it visits;
  a cell scores list by list, in tiles of a fixed number of bytes, and only the best of each query leave it.
* Final ranking: top-k per query over the block results (``WindowGroupLimit``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators.blocks import SCORE_DECIMALS, leave_out_self, top_of_cells
from kestrel.operators.retrieve import directed_rows, rank_within, unit_matrix, vector_blocks
from kestrel.session import materialize

#: Vectors per list that the centroids are fitted on (a documented sample; every vector is indexed).
FIT_PER_LIST = 256
MAX_LISTS = 4096


def knn_ann(
    index: DataFrame,
    queries: DataFrame,
    k: int = 50,
    key_col: str = "vec_id",
    vec_col: str = "embedding",
    qvec_col: str = "query_vector",
    n_lists: int | None = None,
    probe_share: float = 0.7,
    exclude_self: bool = False,
    max_block: int | None = None,
    max_query_block: int | None = None,
    seed: int = 42,
    max_iter: int = 10,
) -> DataFrame:
    """Approximate top-``k`` by cosine: ``(query_id, key, score, rank)``.

    ``probe_share`` is the share of the index a query reads: small where vectors form clusters, large where
    they are spread evenly (as random vectors are).  With 1.0 all lists are probed and the result is exact.
    ``max_block`` and ``max_query_block`` bound the rows of a block (by default by their bytes).
    Null, zero and non-finite vectors take no part.
    """
    vecs = materialize(directed_rows(index, key_col, vec_col), "ivf-vectors")
    n = vecs.count()
    if n == 0:
        none = index.select(F.lit(0).cast("long").alias("query_id"), key_col, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return none.where(F.lit(False))
    lists = min(MAX_LISTS, n_lists or max(1, int(math.sqrt(n))))
    fit_on = vecs if n <= lists * FIT_PER_LIST else vecs.where(F.pmod(F.xxhash64(key_col), F.lit(n)) < lists * FIT_PER_LIST)
    km = KMeans(k=lists, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="list_id")
    unit = array_to_vector(F.transform("u", lambda v: v.cast("double") / F.col("u_norm"))).alias("features")
    model = km.fit(fit_on.select(unit))
    centers = np.array(model.clusterCenters(), dtype=np.float64)
    cnorm = np.linalg.norm(centers, axis=1)
    unit_centers = centers / np.where(cnorm > 0, cnorm, 1.0)[:, None]
    assigned = materialize(model.transform(vecs.select("*", unit)).select(key_col, "u", "u_norm", "list_id"), "ivf-lists")
    sizes = np.zeros(len(centers))
    for r in assigned.groupBy("list_id").count().collect():  # one row per list
        sizes[r["list_id"]] = r["count"]
    wanted = max(float(k + 1), probe_share * n)

    asked = directed_rows(queries, "query_id", qvec_col, "q")
    n_i, n_j = vector_blocks(vecs, asked, k)
    if max_block:
        n_i = -(-n // max_block)
    if max_query_block:
        n_j = max(1, -(-asked.count() // max_query_block))
    n_groups = min(n_i, len(centers))
    # Blocks per group from the list sizes (one number per group, at most MAX_LISTS).
    held = [int(sizes[g::n_groups].sum()) for g in range(n_groups)]
    most = max_block or -(-n // n_i)
    n_sub = np.array([max(1, -(-h // (2 * most))) for h in held])

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("block_i", T.StringType()), T.StructField("lists", T.ArrayType(T.IntegerType()))])))
    def visits(v: pd.Series, norm: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        units = np.stack(v.to_numpy()).astype(np.float64) / norm.to_numpy()[:, None]
        order = np.argsort(-(units @ unit_centers.T), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        out = []
        for row, b in zip(order, before):
            lists = np.sort(row[: max(1, int((b < wanted).sum()))]).astype(np.int32)
            own = [(g, lists[lists % n_groups == g]) for g in np.unique(lists % n_groups)]
            out.append([{"block_i": f"{g}-{sub}", "lists": chosen} for g, chosen in own for sub in range(n_sub[g])])
        return pd.Series(out)

    group = F.col("list_id") % n_groups
    subs = F.element_at(F.array(*[F.lit(int(x)) for x in n_sub]), group + 1)
    block_i = F.concat_ws("-", group.cast("string"), F.pmod(F.xxhash64(key_col), subs).cast("string"))
    left = assigned.select("*", block_i.alias("block_i"), F.explode(F.sequence(F.lit(0), F.lit(n_j - 1))).alias("block_j"))
    block_j = F.pmod(F.xxhash64("query_id", F.lit("j")), F.lit(n_j)).cast("int").alias("block_j")
    right = asked.select("*", block_j, F.explode(visits("q", "q_norm")).alias("visit")).select("query_id", "q", "q_norm", "block_j", "visit.*")

    def scorer(part: pd.DataFrame, order: np.ndarray):
        keys = part[key_col].to_numpy()
        by_list = np.argsort(part["list_id"].to_numpy(), kind="stable")
        units = unit_matrix(part, "u")[by_list].T
        ids, starts = np.unique(part["list_id"].to_numpy()[by_list], return_index=True)
        spans = dict(zip(ids.tolist(), zip(starts, [*starts[1:], len(part)])))

        def score(qs: pd.DataFrame) -> np.ndarray:
            q = unit_matrix(qs, "q")
            lists = qs["lists"].to_numpy()
            row = np.repeat(np.arange(len(qs)), [len(x) for x in lists])
            visited = np.concatenate(lists)
            s = np.full((len(qs), len(part)), -np.inf)
            for list_id, (a, b) in spans.items():
                who = row[visited == list_id]
                s[who, a:b] = q[who] @ units[:, a:b]
            out = np.empty_like(s)
            out[:, by_list] = s
            if exclude_self:
                leave_out_self(out, qs["query_id"].to_numpy(), keys, order)
            return out

        return score

    cands = top_of_cells(left, right, key_col, k, scorer)
    top = rank_within(cands, "query_id", key_col, "score", k)
    return top.select("query_id", key_col, F.round("score", SCORE_DECIMALS).alias("score"), "rank")


def recall_at_k(approx: DataFrame, exact: DataFrame, key_col: str) -> DataFrame:
    """Share of the exact top-k found by the approximate top-k, overall (one row)."""
    hit = exact.join(approx.select("query_id", key_col), ["query_id", key_col], "left_semi").count()
    total = exact.count()
    return exact.sparkSession.createDataFrame([(hit, total, hit / total if total else 1.0)], "found long, expected long, recall double")
