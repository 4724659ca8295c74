"""Retrieval: BM25 and cosine against brute force, ranking ties, fusion, filters, boosts, ANN recall."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions.text import hashed_embedding
from kestrel.operators import retrieve as R
from tests.conftest import SF_CHECK, SF_SMALL


def _tok(t):
    return [w for w in re.split(r"[^\w]+|_", t.lower()) if w]


def _bm25(chunks, queries, k1=1.2, b=0.75):
    toks = {cid: _tok(t) for cid, t in chunks}
    n = len(toks)
    avgdl = sum(len(v) for v in toks.values()) / n
    df = Counter(w for v in toks.values() for w in set(v))
    out = {}
    for qid, qt in queries:
        for cid, v in toks.items():
            tf = Counter(v)
            s = 0.0
            for w in set(_tok(qt)):
                if tf[w]:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    s += idf * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(v) / avgdl))
            if s:
                out[(qid, cid)] = s
    return out


def _top(scores, k):
    by_q = {}
    for (q, c), s in scores.items():
        by_q.setdefault(q, []).append((-round(s, 6), c, s))
    res = {}
    for q, lst in by_q.items():
        lst.sort()
        res[q] = [c for _, c, _ in lst[:k]]
    return res


CHUNKS = [
    ("c1", "the ice sheet melts in the sea"),
    ("c2", "sea surface temperature and the ocean"),
    ("c3", "venice canals flood when the sea rises"),
    ("c4", "nothing relevant here at all"),
    ("c5", "the the the the sea"),
]
QUERIES = [(1, "sea surface"), (2, "ice sheet"), (3, "zebra"), (4, "the")]


def test_bm25_matches_brute_force(spark):
    idx = spark.createDataFrame(CHUNKS, "chunk_id string, chunk string")
    q = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    got = R.keyword_search(idx, q, k=3).collect()
    want = _top(_bm25(CHUNKS, QUERIES), 3)
    by_q = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_q.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert by_q == want
    assert 3 not in by_q  # a query with no hit has no rows
    assert all(len(v) <= 3 for v in by_q.values())


def test_rank_ties_break_on_key(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 1.0000000001), (2, "z", None)], "query_id long, chunk_id string, score double")
    rows = R.rank_within(df, "query_id", "chunk_id", "score", 2).collect()
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in rows)
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "z")]


def test_knn_exact_matches_numpy(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = emb.limit(20).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = R.knn_search(emb, q, k=7, key_col="vec_id", vec_col="embedding", exclude_self=True).collect()
    pdf = emb.toPandas()
    m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    m = m / np.linalg.norm(m, axis=1)[:, None]
    ids = pdf["vec_id"].to_numpy()
    qids = [r["query_id"] for r in q.collect()]
    for qid in qids:
        qi = int(np.flatnonzero(ids == qid)[0])
        s = m @ m[qi]
        order = sorted((-round(float(s[j]), 6), int(ids[j])) for j in range(len(ids)) if ids[j] != qid)[:7]
        want = [i for _, i in order]
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == qid), key=lambda r: r["rank"])]
        assert mine == want


def test_rrf_fusion(spark):
    kw = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, rank int")
    vec = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, chunk_id string, rank int")
    got = {r["chunk_id"]: r["score"] for r in R.fuse_rankings(kw, vec).collect()}
    assert math.isclose(got["b"], 1 / 62 + 1 / 61)
    assert math.isclose(got["a"], 1 / 61) and math.isclose(got["c"], 1 / 62)


def test_prefix_match_any(spark):
    df = spark.createDataFrame([(["Ice Sheet"],), (["Venice"],), (["iceland"],), ([],), (None,)], "loc array<string>")
    got = [r["m"] for r in df.select(R.prefix_match_any(F.col("loc"), "ice").alias("m")).collect()]
    assert got == [True, False, True, False, False]


def test_tag_parameter_and_boost(spark):
    df = spark.createDataFrame([("tags-ocean, 'sea surface', seas, Surface",)], "p string")
    name, tags = R.parse_tag_parameter(F.col("p"))
    r = df.select(name.alias("n"), tags.alias("t")).first()
    assert r["n"] == "tags" and r["t"] == ["ocean", "sea surface", "seas", "surface"]
    hits = spark.createDataFrame([(1, "a", 1.0, ["Ocean"]), (1, "b", 1.0, ["land"]), (1, "c", 2.0, [])], "query_id long, chunk_id string, score double, locations array<string>")
    boosted = {x["chunk_id"]: x["score"] for x in R.tag_boost(hits, F.array(*[F.lit(t) for t in r["t"]])).collect()}
    assert boosted == {"a": 5.0, "b": 1.0, "c": 2.0}


def test_attribute_filter_empty_is_noop(spark):
    df = spark.createDataFrame(CHUNKS, "chunk_id string, chunk string")
    assert R.attribute_filter(df, "").count() == len(CHUNKS)
    assert R.attribute_filter(df, {"chunk_id": ["c1", "c3"]}).count() == 2


def test_knn_ann_recall_and_whole_results(spark):
    from kestrel.operators.ann import knn_ann, recall_at_k

    emb = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = R.knn_search(emb, q, k=50, key_col="vec_id", vec_col="embedding", exclude_self=True).cache()
    approx = knn_ann(emb, q, k=50, key_col="vec_id", vec_col="embedding", exclude_self=True, max_block=64, max_query_block=64).cache()
    assert recall_at_k(approx, exact, "vec_id").first()["recall"] >= 0.9
    assert {r["count"] for r in approx.groupBy("query_id").count().collect()} == {50}  # never fewer than k
    few = knn_ann(emb, q, k=50, key_col="vec_id", vec_col="embedding", exclude_self=True, probe_share=0.0)
    assert {r["count"] for r in few.groupBy("query_id").count().collect()} == {50}


def test_knn_with_copies_zero_vectors_and_string_ids(spark):
    rows = [(f"k{i:04d}", [1.0, 0.0]) for i in range(3000)] + [("z", [0.0, 0.0]), ("n", None), ("w", [0.0, 2.0])]
    idx = spark.createDataFrame(rows, "chunk_id string, text_vector array<float>")
    q = spark.createDataFrame([("a", [3.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None), ("b", [0.0, 1.0])], "query_id string, query_vector array<float>")
    assert R.vector_scores(idx, q, 5).count() <= 25  # 3,000 equal scores leave a block as five rows
    got = {}
    for r in R.knn_search(idx, q, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {"a": [f"k{i:04d}" for i in range(5)], "b": ["w", "k0000", "k0001", "k0002", "k0003"]}


def test_block_selection_keeps_every_possible_top_row():
    from kestrel.operators.blocks import best

    rng = np.random.default_rng(3)
    for _ in range(50):
        s = np.round(rng.random((4, 40)) * 5) / 5 + rng.integers(-3, 4, (4, 40)) * 1e-7
        keys = rng.permutation(40)
        for row, at in zip(s, best(s, keys, 6, np.argsort(keys))):
            want = sorted(range(40), key=lambda c: (-np.round(row[c], 6), keys[c]))[:6]
            assert set(want) <= set(at.tolist())


def test_empty_inputs_give_empty_results(spark):
    idx = spark.createDataFrame(CHUNKS, "chunk_id string, chunk string")
    no_idx = spark.createDataFrame([], "chunk_id string, chunk string")
    q = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    no_q = spark.createDataFrame([], "query_id long, query_text string")
    assert R.keyword_search(idx, no_q, k=3).count() == 0
    assert R.keyword_search(no_idx, q, k=3).count() == 0
    vidx = spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, text_vector array<float>")
    vq = spark.createDataFrame([], "query_id long, query_vector array<float>")
    assert R.knn_search(vidx, vq, k=3).count() == 0


def test_blocks_grow_with_the_bytes_of_a_side_not_with_its_rows():
    from kestrel.operators.blocks import block_counts

    for n in (12_000, 120_000):  # copies of a row: as many at ten times the rows
        n_i, n_j = block_counts(n, n, 65_536, 65_536, 50, 320, 24)
        assert n_i + n_j <= 26 and n_i * n_j >= 24
    n_i, n_j = block_counts(720_000, 720_000, 65_536, 65_536, 50, 320, 24)
    assert max(n_i, n_j) <= 11
    assert block_counts(1_000_000, 200, 65_536, 65_536, 50, 320, 24)[1] == 1  # few queries: only they are copied


def test_ann_sends_a_query_once_per_block_of_lists(spark):
    from kestrel.operators.ann import knn_ann

    emb = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = knn_ann(emb, q, k=10, n_lists=40, probe_share=1.0, exclude_self=True).select("query_id", "vec_id", "rank")
    want = R.knn_search(emb, q, k=10, key_col="vec_id", vec_col="embedding", exclude_self=True).select("query_id", "vec_id", "rank")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "list_id" in plan and "lists" in plan  # no probe table joined with blocks


def test_only_counts_of_the_queries_terms_are_stored_and_no_bound_changes_hits(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "sea ice sea"), ("b", "ice floe"), ("c", "land"), ("d", "")], "chunk_id string, chunk string")
    queries = spark.createDataFrame([(1, "sea ice"), (2, "floe sea"), (3, "none")], "query_id long, query_text string")
    held = {r["chunk_id"]: (r["dl"], dict(zip(r["terms"], r["tfs"]))) for r in R.counted(docs, queries).collect()}
    assert held == {"a": (3, {"sea": 2, "ice": 1}), "b": (2, {"ice": 1, "floe": 1}), "c": (1, {}), "d": (0, {})}
    hits = lambda: sorted(map(tuple, R.keyword_search(docs, queries, k=2).collect()))
    want = hits()
    assert [h[:2] for h in want] == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    monkeypatch.setattr(R, "VOCABULARY_BYTES", 0)
    assert R.counted(docs, queries).where("chunk_id = 'c'").first()["terms"] == ["land"]
    assert hits() == want


def test_streamed_index_gives_the_rows_of_the_grid(spark, monkeypatch):
    """More queries than a grid takes: copies, ties at the border, queries without a hit, zero vectors, several index blocks."""
    from kestrel.operators import streamed as S

    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda i: " ".join(vocabulary[(i * j * j + i) % (5 + i % 36)] for j in range(1, 3 + i % 9))
    chunks = spark.createDataFrame([(f"k{i:03d}", text(i % 190)) for i in range(300)], "chunk_id string, chunk string")
    queries = spark.createDataFrame([(i, text(7 * i + 3)) for i in range(60)] + [(98, "nowhere to be found"), (99, "")], "query_id long, query_text string")
    chunks = chunks.withColumn("text_vector", hashed_embedding(F.col("chunk"), 16)).localCheckpoint()
    queries = queries.withColumn("query_vector", hashed_embedding(F.col("query_text"), 16)).localCheckpoint()
    run = lambda: [sorted(map(tuple, f(chunks, queries, 7).collect())) for f in (R.keyword_search, R.knn_search)]
    before = run()
    monkeypatch.setattr(R, "CANDIDATE_ROWS", 0)
    monkeypatch.setattr(R, "block_counts", lambda *a: (2, 1))
    monkeypatch.setattr(S, "BLOCK_ROWS", 32)
    after = run()
    assert all(before) and after == before
    cands = R.keyword_candidates(chunks, queries, 7)
    assert cands.count() <= 3 * 7 * queries.count()  # a few times k a query, whatever the number of blocks


def test_rerank_moves_only_words_of_the_queries(spark):
    index = spark.createDataFrame([("a", "Red boat", ["Sea"], "the red boat " + "filler " * 500), ("b", None, ["Sea"], "boat"), ("c", "x", ["Lake"], "nothing")], "chunk_id string, title string, locations array<string>, chunk string")
    queries = spark.createDataFrame([(1, "red sea boat"), (2, "?"), (3, None)], "query_id long, query_text string")
    cands = spark.createDataFrame([(q, c, 1.0) for q in (1, 2, 3) for c in "abc"], "query_id long, chunk_id string, score double")
    got = {(r["query_id"], r["chunk_id"]): r["reranker_score"] for r in R.rerank_candidates(cands, index, queries).collect()}
    one = 4 / 4.5 / 3
    assert got[1, "a"] == pytest.approx((2 * 2 + 1.5 + 2) * one) and got[1, "b"] is None and got[1, "c"] == 0.0
    assert got[2, "a"] == 0.0 and got[3, "a"] is None
    plan = R.rerank_candidates(cands, index, queries)._jdf.queryExecution().executedPlan().toString()
    assert not any("query_id" in x for x in plan.splitlines() if "Exchange hashpartitioning" in x)  # no chunk's text goes to each of its queries
