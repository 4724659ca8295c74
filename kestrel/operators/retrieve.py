"""Batch retrieval: a whole table of queries against a chunk index.

Every operator takes a queries frame ``(query_id, query_text[, query_vector])`` and the
index, and returns ``(query_id, chunk_id, score, rank)``.

Ranking everywhere: score rounded to 6 decimals, descending, then ``chunk_id`` ascending,
always partitioned by ``query_id``.  ``row_number() <= k`` is planned as a partial
``WindowGroupLimit`` before the shuffle, so a query that matches every chunk moves at
most ``k`` rows per map task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.text import hashed_embedding, term_counts, tokens
from kestrel.operators.blocks import SCORE_DECIMALS, SIDE_BYTES, block_counts, grid, leave_out_self, top_of_cells
from kestrel.operators.streamed import CANDIDATE_ROWS, keyword_stream, vector_stream
from kestrel.session import discard, materialize, settle


def rank_within(df: DataFrame, group: str, key: str, score: str, k: int | None, *extra_order: Column) -> DataFrame:
    """Add ``rank`` (1-based) per ``group`` by rounded ``score`` desc, then extras, then ``key``; keep ``rank <= k``."""
    order = [F.round(F.col(score), SCORE_DECIMALS).desc(), *extra_order, F.col(key).asc()]
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= k) if k is not None else ranked


# --------------------------------------------------------------------------- keyword (BM25)

VOCABULARY_BYTES = 4 * 1024 * 1024  # of query terms that tasks are sent


def asked_terms(queries: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """The distinct terms of the queries, written once, and a shared set of them if they have ``VOCABULARY_BYTES`` at most."""
    asked = materialize(queries.select(F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term")).distinct(), "asked-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term").cast("long")), F.lit(0)).alias("b")).first()["b"]
    only = queries.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in asked.collect())) if size <= VOCABULARY_BYTES else None
    return asked, only


def counted(index: DataFrame, queries: DataFrame, key_col: str = "chunk_id", text_col: str = "chunk") -> DataFrame:
    """``(key, dl, terms, tfs)`` of the index, written once: the number of tokens of a chunk, and its distinct tokens with
    their counts.  Of those only the ones that a query has, where the queries' terms are ``VOCABULARY_BYTES`` at most."""
    only = asked_terms(queries)[1]
    docs = index.select(key_col, tokens(F.col(text_col)).alias("toks"))
    docs = docs.select(key_col, F.size("toks").alias("dl"), term_counts(F.col("toks"), only).alias("c"))
    return materialize(docs.select(key_col, "dl", "c.terms", "c.tfs"), "chunk-counts")


def weighted_terms(docs: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """``(query_id, terms, idf)``: the distinct terms of each query that occur in the index, with weights
    ``ln(1 + (N - df + 0.5) / (df + 0.5))``.  A query without such a term has no row."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))
    seen = docs.select(F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    dfreq = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1.0 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(dfreq, "term").select("query_id", F.struct("term", idf.alias("idf")).alias("t"))
    return weighted.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")
    )


def keyword_candidates(index: DataFrame, queries: DataFrame, k: int, key_col: str = "chunk_id", text_col: str = "chunk", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 scores of the chunks that can be among the best ``k`` of a query: at most a few times ``k``
    rows per query and index block leave a block.

    The index is tokenised once, and counts of the queries' terms are all that moves.  A block turns its chunks into a matrix of term weights over the vocabulary of
    its queries and multiplies it with the queries' weights, so a term in a third of all chunks
    costs a column, not rows.  Where the candidates of all blocks were too many, the blocks of the index are read in
    turn instead (``streamed``).
    """
    docs = counted(index, queries, key_col, text_col)
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()  # one row
    n_docs, avgdl = stats["n"], float(stats["avgdl"] or 0.0)
    asked = materialize(weighted_terms(docs, queries, n_docs), "query-terms")

    def scorer(rows: pd.DataFrame, order: np.ndarray):
        held, lengths = rows["terms"].map(len).to_numpy(), rows["dl"].to_numpy()

        def score(qs: pd.DataFrame) -> np.ndarray:
            q_len = qs["terms"].map(len).to_numpy()
            flat = np.concatenate([np.asarray(t, dtype=object) for t in qs["terms"]])
            codes, vocab = pd.factorize(flat)
            weights = np.zeros((len(qs), len(vocab)))
            weights[np.repeat(np.arange(len(qs)), q_len), codes] = np.concatenate(qs["idf"].to_list())
            out = np.full((len(qs), len(rows)), -np.inf)
            places = pd.Index(vocab)
            step = max(1, (32 << 20) // (8 * max(1, len(vocab))))  # rows of a term matrix of 32 MB
            for a in range(0, len(rows), step):
                part, n, dl = rows.iloc[a : a + step], held[a : a + step], lengths[a : a + step].astype(float)
                if not n.sum():
                    continue
                at = places.get_indexer(np.concatenate([np.asarray(t, dtype=object) for t in part["terms"]]))
                row, tfs = np.repeat(np.arange(len(part)), n)[at >= 0], np.concatenate(part["tfs"].to_list())[at >= 0]
                tf = np.zeros((len(part), len(vocab)))
                tf[row, at[at >= 0]] = tfs
                norm = tf + k1 * (1.0 - b + b * dl / avgdl)[:, None]
                s = weights @ (tf * (k1 + 1.0) / norm).T
                out[:, a : a + step] = np.where(s > 0, s, -np.inf)
            return out

        return score

    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    n_asked = asked.count()
    n_i, n_j = block_counts(n_docs, n_asked, 8192, 8192, k, 2500, tasks)
    if n_i > 1 and n_i * n_asked * k > CANDIDATE_ROWS:
        found = keyword_stream(docs, asked, key_col, k, avgdl, k1, b, n_docs, n_asked)
        discard(docs)
        return found
    left, right = grid(docs, asked, key_col, n_i, n_j)
    return top_of_cells(left, right, key_col, k, scorer)


def keyword_search(index: DataFrame, queries: DataFrame, k: int = 5, key_col: str = "chunk_id", text_col: str = "chunk") -> DataFrame:
    """Top-``k`` chunks per query by BM25 (k1=1.2, b=0.75)."""
    top = rank_within(keyword_candidates(index, queries, k, key_col, text_col), "query_id", key_col, "score", k)
    return top.select("query_id", key_col, F.round("score", SCORE_DECIMALS).alias("score"), "rank")


# --------------------------------------------------------------------------- vectors

def vectorize_query(queries: DataFrame, dims: int, text_col: str = "query_text", out_col: str = "query_vector") -> DataFrame:
    """Queries through the same hashed embedder as the chunks."""
    return queries.withColumn(out_col, hashed_embedding(F.col(text_col), dims))


def directed_rows(df: DataFrame, key_col: str, vec_col: str, out_col: str = "u") -> DataFrame:
    """``(key, u, u_norm)``: vectors as stored with their length; null, empty, zero and non-finite ones are left out."""
    norm = F.sqrt(F.aggregate(F.col(vec_col), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    with_norm = df.select(key_col, F.col(vec_col).alias(out_col), norm.alias(f"{out_col}_norm"))
    n = F.col(f"{out_col}_norm")
    return with_norm.where(F.col(out_col).isNotNull() & (n > 0) & (n < float("inf")))


def unit_matrix(part: pd.DataFrame, col: str) -> np.ndarray:
    """The vectors of ``directed_rows`` scaled to length one, a row each."""
    return np.stack(part[col].to_numpy()).astype(np.float64) / part[f"{col}_norm"].to_numpy()[:, None]


def vector_blocks(rows: DataFrame, asked: DataFrame, k: int) -> tuple[int, int]:
    """Numbers of index and query blocks for two frames of ``directed_rows``, from counts and vector lengths."""
    return _vector_blocks(rows, asked, k)[:2]


def _vector_blocks(rows: DataFrame, asked: DataFrame, k: int) -> tuple[int, int, int, int]:
    """``vector_blocks``, and the numbers of rows and queries."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("u")).alias("dims")).first()  # one row
    dims, n_asked = seen["dims"] or 1, asked.count()
    most = max(1024, SIDE_BYTES // (8 * dims))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return *block_counts(seen["n"], n_asked, most, most, k, 4 * dims + 64, tasks), seen["n"], n_asked


def vector_scores(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    key_col: str = "chunk_id",
    vec_col: str = "text_vector",
    qvec_col: str = "query_vector",
    exclude_self: bool = False,
) -> DataFrame:
    """Exact cosine candidates: for each query, a superset of its top-``k`` from every index block.

    Vectors travel as stored, with their length; a cell scales them to unit length and is one matrix product in
    tiles of a fixed number of bytes.  A query or row without a direction (null or zero vector) takes no part.
    """
    rows = directed_rows(index, key_col, vec_col)
    asked = directed_rows(queries, "query_id", qvec_col, "q")

    def scorer(part: pd.DataFrame, order: np.ndarray):
        units, keys = unit_matrix(part, "u").T, part[key_col].to_numpy()

        def score(qs: pd.DataFrame) -> np.ndarray:
            s = unit_matrix(qs, "q") @ units
            if exclude_self:
                leave_out_self(s, qs["query_id"].to_numpy(), keys, order)
            return s

        return score

    n_i, n_j, n_rows, n_asked = _vector_blocks(rows, asked, k)
    if n_i > 1 and n_i * n_asked * k > CANDIDATE_ROWS and not exclude_self:
        return vector_stream(rows, asked, key_col, k, n_rows, n_asked)
    left, right = grid(rows, asked, key_col, n_i, n_j)
    return top_of_cells(left, right, key_col, k, scorer)


def knn_search(
    index: DataFrame,
    queries: DataFrame,
    k: int = 50,
    key_col: str = "chunk_id",
    vec_col: str = "text_vector",
    qvec_col: str = "query_vector",
    exclude_self: bool = False,
) -> DataFrame:
    """Exact k nearest neighbours by cosine: ``(query_id, key, score, rank)``."""
    cands = vector_scores(index, queries, k, key_col, vec_col, qvec_col, exclude_self)
    top = rank_within(cands, "query_id", key_col, "score", k)
    return top.select("query_id", key_col, F.round("score", SCORE_DECIMALS).alias("score"), "rank")


# --------------------------------------------------------------------------- fusion and boosts

def fuse_rankings(*rankings: DataFrame, key_col: str = "chunk_id", rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: ``sum(1 / (rrf_k + rank))`` per (query, chunk) over the given rankings."""
    parts = [r.select("query_id", key_col, (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("rrf")) for r in rankings]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return allp.groupBy("query_id", key_col).agg(F.sum("rrf").alias("score"))


def hybrid_candidates(index: DataFrame, queries: DataFrame, k_each: int = 50, rrf_k: int = 60, key_col: str = "chunk_id") -> DataFrame:
    """Fused keyword + vector candidates (each list cut at ``k_each``), unranked."""
    kw = keyword_search(index, queries, k_each, key_col)
    vec = knn_search(index, queries, k_each, key_col)
    # Stored, so that the planner knows how few they are when they meet the index fields.
    return settle(fuse_rankings(kw, vec, key_col=key_col, rrf_k=rrf_k), "fused")


def hybrid_search(index: DataFrame, queries: DataFrame, top: int = 5, k_each: int = 50, rrf_k: int = 60, key_col: str = "chunk_id") -> DataFrame:
    """Keyword and vector rankings fused by RRF, top ``top`` per query."""
    fused = hybrid_candidates(index, queries, k_each, rrf_k, key_col)
    ranked = rank_within(fused, "query_id", key_col, "score", top)
    return ranked.select("query_id", key_col, F.round("score", SCORE_DECIMALS).alias("score"), "rank")


def prefix_match_any(arr: Column, prefix: str) -> Column:
    """True when some element of ``arr`` has a word starting with ``prefix`` (case-insensitive)."""
    import re

    pat = r"(?i)(^|[^\p{L}\p{N}])" + re.escape(prefix.lower())
    return F.coalesce(F.exists(arr, lambda x: F.lower(x).rlike(pat)), F.lit(False))


def attribute_filter(df: DataFrame, predicate: dict | str | None) -> DataFrame:
    """Equality filter on filterable fields: ``{"field": value}`` (value or list of values).
    An empty string / empty dict / None means no predicate."""
    if not predicate:
        return df
    if isinstance(predicate, str):
        return df.where(predicate)
    cond = F.lit(True)
    for field, value in predicate.items():
        cond = cond & (F.col(field).isin(list(value)) if isinstance(value, (list, tuple, set)) else (F.col(field) == F.lit(value)))
    return df.where(cond)


def parse_tag_parameter(param: Column) -> tuple[Column, Column]:
    """``"tags-ocean, 'sea surface', seas"`` -> (parameter name, lower-cased tag array without quotes)."""
    name = F.substring_index(param, "-", 1)
    rest = param.substr(F.instr(param, "-") + 1, F.length(param))
    tags = F.transform(F.split(rest, ","), lambda t: F.lower(F.trim(F.regexp_replace(t, "'", ""))))
    return name, F.filter(tags, lambda t: t != F.lit(""))


def tag_boost(hits: DataFrame, tags: Column, boost: float = 5.0, score_col: str = "score", field: str = "locations") -> DataFrame:
    """Multiply the score by ``boost`` when ``field`` shares an element with ``tags``."""
    overlap = F.coalesce(F.arrays_overlap(F.transform(F.col(field), lambda x: F.lower(x)), tags), F.lit(False))
    return hits.withColumn(score_col, F.col(score_col) * F.when(overlap, F.lit(boost)).otherwise(F.lit(1.0)))


# Fixed values (design): re-ranker field weights and output scale.
RERANK_WEIGHTS = {"title": 2.0, "locations": 1.5, "chunk": 1.0}
RERANK_SCALE = 4.0


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("n", "title", "locations", "chunk")]))
def _shared_words(query: pa.Array, title: pa.Array, locations: pa.Array, chunk: pa.Array) -> pa.Array:
    """Numbers of the distinct words of a query and of those in each field (null: no such text); words are parted by spaces."""
    held: dict = {}
    asked = [q if q is None else held.setdefault(q, frozenset(q.split())) for q in query.to_pylist()]
    counts = [pa.array([None if q is None or f is None else len(q.intersection(f.split())) for q, f in zip(asked, field.to_pylist())], pa.int32()) for field in (title, locations, chunk)]
    return pa.StructArray.from_arrays([pa.array([None if q is None else len(q) for q in asked], pa.int32()), *counts], ["n", "title", "locations", "chunk"])


def words(text: Column) -> Column:
    """The tokens of a text, parted by spaces."""
    return F.array_join(tokens(text), " ")


def covered(query: Column, title: Column, locations: Column, chunk: Column) -> Column:
    """``rerank_score`` of texts that are ``words``."""
    n = _shared_words(query, title, locations, chunk)
    nq = F.greatest(n["n"], F.lit(1))
    total = sum((F.lit(w) * (n[f] / nq) for f, w in list(RERANK_WEIGHTS.items())[1:]), F.lit(RERANK_WEIGHTS["title"]) * (n["title"] / nq))
    return F.when(n["n"] == 0, F.lit(0.0)).otherwise(total * F.lit(RERANK_SCALE / sum(RERANK_WEIGHTS.values())))


def rerank_score(query_text: Column, title: Column, locations: Column, chunk: Column) -> Column:
    """Weighted share of distinct query tokens found in title, keywords (locations) and content,
    scaled to 0..4."""
    return covered(words(query_text), words(title), words(F.array_join(locations, " ")), words(chunk))


QUERIES_BYTES = 32 * 1024 * 1024  # of query texts that tasks are sent


def rerank_candidates(cands: DataFrame, index: DataFrame, queries: DataFrame, depth: int = 50, key_col: str = "chunk_id", also: tuple[str, ...] = ()) -> DataFrame:
    """The best ``depth`` first-stage candidates per query with ``reranker_score`` added, and the columns ``also`` of ``queries``.

    ``cands``: ``(query_id, chunk_id, score)``.  Only ``depth`` rows per query reach the
    joins with the index fields and the query text.  Of a chunk's text only the words that a query has are moved.
    """
    first = settle(rank_within(cands, "query_id", key_col, "score", depth).drop("rank"), "first-stage")
    asked = queries.select("query_id", words(F.col("query_text")).alias("query_text"), *also)
    size = asked.agg(F.coalesce(F.sum(F.octet_length("query_text").cast("long") + 64), F.lit(0)).alias("b")).first()["b"]
    asked = F.broadcast(asked) if size <= QUERIES_BYTES else asked  # else each candidate takes the fields of its chunk to its query
    only = asked_terms(queries)[1]
    said = F.array_join(term_counts(tokens(F.col("chunk")), only)["terms"], " ") if only else words(F.col("chunk"))
    fields = index.select(key_col, words(F.col("title")).alias("title"), words(F.array_join("locations", " ")).alias("locations"), said.alias("chunk"))
    joined = first.join(fields, key_col).join(asked, "query_id")
    return joined.select(
        "query_id",
        *also,
        key_col,
        "score",
        covered(F.col("query_text"), F.col("title"), F.col("locations"), F.col("chunk")).alias("reranker_score"),
    )


def semantic_rerank(cands: DataFrame, index: DataFrame, queries: DataFrame, depth: int = 50, top: int = 5, key_col: str = "chunk_id") -> DataFrame:
    """Re-score the best ``depth`` candidates per query with the field-weighted coverage score and
    keep ``top``; ties keep the first-stage order.  Output: ``query_id, chunk_id, reranker_score, score, rank``."""
    scored = rerank_candidates(cands, index, queries, depth, key_col)
    return _rank_reranked(scored, "query_id", key_col, top)


def _rank_reranked(scored: DataFrame, group: str, key_col: str, top: int) -> DataFrame:
    ranked = rank_within(scored, group, key_col, "reranker_score", top, F.round(F.col("score"), SCORE_DECIMALS).desc())
    return ranked.select(
        group,
        key_col,
        F.round("reranker_score", SCORE_DECIMALS).alias("reranker_score"),
        F.round("score", SCORE_DECIMALS).alias("score"),
        "rank",
    )


def boosted_candidates(index: DataFrame, queries: DataFrame, tags: Column | None, boost: float = 5.0, k_each: int = 50, key_col: str = "chunk_id") -> DataFrame:
    fused = hybrid_candidates(index, queries, k_each, key_col=key_col)
    if tags is None:
        return fused
    factors = tag_boost(index.select(key_col, "locations", F.lit(1.0).alias("factor")), tags, boost, "factor").select(key_col, "factor")  # once a chunk
    return fused.join(factors, key_col).select("query_id", key_col, (F.col("score") * F.col("factor")).alias("score"))


def semantic_hybrid(
    index: DataFrame,
    queries: DataFrame,
    tags: Column | None = None,
    boost: float = 5.0,
    depth: int = 50,
    top: int = 5,
    k_each: int = 50,
    key_col: str = "chunk_id",
) -> DataFrame:
    """Hybrid retrieval, tag boost on the fused score, field-weighted re-rank of the best ``depth``,
    top ``top`` per query."""
    return semantic_rerank(boosted_candidates(index, queries, tags, boost, k_each, key_col), index, queries, depth, top, key_col)


def multi_intent_retrieve(
    index: DataFrame,
    intents: DataFrame,
    tags: Column | None = None,
    boost: float = 5.0,
    depth: int = 50,
    top: int = 5,
    key_col: str = "chunk_id",
) -> DataFrame:
    """Requests that carry several intents: every intent ``(request_id, query_id, query_text[, query_vector])``
    is retrieved on its own (semantic hybrid, ``depth`` re-ranked candidates); a chunk's score for the
    request is its best score over the intents; top ``top`` per request."""
    scored = rerank_candidates(boosted_candidates(index, intents, tags, boost, key_col=key_col), index, intents, depth, key_col, also=("request_id",))
    per_req = scored.groupBy("request_id", key_col).agg(F.max("reranker_score").alias("reranker_score"), F.max("score").alias("score"))
    return _rank_reranked(per_req, "request_id", key_col, top)


def retrieve_per_source(
    index: DataFrame, requests: DataFrame, source_col: str, sources: list[str], top: int = 3, key_col: str = "chunk_id",
    reference_cols: tuple[str, ...] = ("title", "source_url"),
) -> DataFrame:
    """Requests ``(query_id, query_text, sources array)`` that name the knowledge sources to search: the best
    ``top`` chunks of each, with reference data.  ``sources`` lists the sources that exist; every one is an index
    of its own (its own term statistics), so a result does not depend on the others.  A request that
    names no existing source, or none at all, has no rows."""
    found = None
    for name in sources:
        asked = requests.where(F.array_contains("sources", name)).select("query_id", "query_text")
        hits = keyword_search(index.where(F.col(source_col) == name), asked, top, key_col).withColumn(source_col, F.lit(name))
        found = hits if found is None else found.unionByName(hits)
    return found.join(index.select(key_col, *reference_cols), key_col).select("query_id", source_col, "rank", key_col, *reference_cols, "score")


def facet_counts(hits: DataFrame, facet: str) -> DataFrame:
    """Number of hits per value of ``facet``."""
    return hits.groupBy(facet).agg(F.count(F.lit(1)).alias("count"))
