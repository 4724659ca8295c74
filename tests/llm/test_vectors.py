"""Vector search: exact top-k against brute force, recall of the forest, edge vectors."""

import numpy as np
import pytest

from kestrel.llm import hash_forest, histogram_topk
from kestrel.llm.queries import QUERIES
from tests.conftest import SF_CHECK

SCHEMA = "vec_id long, embedding array<float>, query_id string, score string, rank string, V string, dim string, h string, i int, lo string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "q", "s", "r", "v", "d", "h", 1, "lo") for i, v in rows], SCHEMA)


EDGES = [
    (0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.1, 0.3]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]),
    (8, [float("inf"), 1.0]), (9, [1.0, None]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (11, [3.0, 1.0]), (11, [3.0, 1.0]), (100, [0.5, 0.25]), (200, [0.0, 0.0]),
]


def rows_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_histogram_edges(spark):
    rows = table(spark, EDGES)
    got = rows_of(histogram_topk.top_k(rows, rows.filter("vec_id in (0, 4, 6, 10, 11, 100, 200)"), 3))
    q = 128 * 128 + 64 * 64
    assert got == {
        0: [(1, 11, 128 * 768 + 64 * 256), (2, 1, q), (3, 2, q)],
        6: [(1, 0, 0), (2, 1, 0), (3, 2, 0)],  # a zero vector takes part
        11: [(1, 0, 128 * 768 + 64 * 256), (2, 1, 128 * 768 + 64 * 256), (3, 2, 128 * 768 + 64 * 256)],
        100: [(1, 11, 128 * 768 + 64 * 256), (2, 0, q), (3, 1, q)],
        200: [(1, 0, 0), (2, 1, 0), (3, 2, 0)],
    }  # 10 is alone with three components
    assert histogram_topk.top_k(rows.limit(0), rows, 3).count() == 0 and histogram_topk.top_k(rows, rows.limit(0), 3).count() == 0


def test_forest_edges(spark):
    rows = table(spark, EDGES)
    got = rows_of(hash_forest.nearest(rows, rows.filter("vec_id in (0, 4, 6, 10, 11, 100)"), 3))
    assert {k: [(r, v) for r, v, _ in x] for k, x in got.items()} == {
        0: [(1, 11), (2, 1), (3, 2)], 11: [(1, 0), (2, 1), (3, 2)], 100: [(1, 11), (2, 0), (3, 1)],
    }
    assert got[0][1][2] == 0.5 * 0.5 + 0.25 * 0.25
    assert hash_forest.nearest(rows.limit(0), rows, 3).count() == 0 and hash_forest.nearest(rows, rows.limit(0), 3).count() == 0


@pytest.mark.parametrize("scale", [1, 256, 3000])
def test_histogram_equals_brute_force_over_several_blocks(spark, monkeypatch, scale):
    from kestrel.llm import vector_grid

    grid = vector_grid.grid
    monkeypatch.setattr(histogram_topk, "grid", lambda a, b: grid(a, b, index_rows=50, query_rows=7))
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[50:150] = x[3]  # a large group of copies: ties over all blocks
    rows = table(spark, [(int(i), [float(c) for c in v]) for i, v in enumerate(x)])
    got = rows_of(histogram_topk.top_k(rows, rows.filter("vec_id % 20 = 0"), 5, scale=scale))
    w = np.floor(x.astype(np.float64) * scale).astype(np.int64)
    for q in range(0, 400, 20):
        s = w @ w[q]
        best = sorted((j for j in range(400) if j != q), key=lambda j: (-s[j], j))[:5]
        assert got[q] == [(r + 1, j, s[j]) for r, j in enumerate(best)]


def test_forest_recall_and_scores(spark):
    emb = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").toPandas()
    x, ids = np.stack(emb["embedding"]).astype(np.float64), emb["vec_id"].to_numpy()
    got = rows_of(QUERIES["op1_hash_prefix_forest"](spark, SF_CHECK))
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        top = set(ids[np.argsort(-s)[:20]].tolist())
        rows = got[ids[q]]
        assert [r for r, _, _ in rows] == list(range(1, 21)) and ids[q] not in {v for _, v, _ in rows}
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        assert all(abs(sc - s[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, sc in rows)
        hit, total = hit + len(top & {v for _, v, _ in rows}), total + 20
    assert hit / total >= 0.93


def test_forest_finds_large_inner_products_of_long_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.1, 3, (600, 1))
    rows = table(spark, [(int(i), [float(c) for c in v]) for i, v in enumerate(x)])
    x = x.astype(np.float32).astype(np.float64)
    got = rows_of(hash_forest.nearest(rows, rows.filter("vec_id % 20 = 0"), 10))
    hit = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:10].tolist()) & {v for _, v, _ in got[q]})
    assert hit / 300 >= 0.9


def test_ascent_meets_longest_prefixes_first():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 12))
    h = hash_forest.hash_strings(x, 6, 1)
    forest = hash_forest.PrefixForest(h)
    met = forest.candidates(h[:20], 40)
    for row in range(20):
        shared = np.array([[32 - int(int(a) ^ int(b)).bit_length() for a, b in zip(h[row], h[j])] for j in range(300)]).max(axis=1)
        level = max(v for v in range(33) if (shared >= v).sum() >= 40)
        assert (met[row] == (shared >= level)).all()


def several_vectors(seed=9):
    """Ids with many different vectors, more than k of them above all others; one of them is a query."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(1, 121)]
    rows += [(200, (rng.standard_normal(6) + 4).tolist()) for _ in range(300)]
    rows += [(20, (rng.standard_normal(6) - 2).tolist()) for _ in range(40)]
    rows += [(20, rng.standard_normal(3).tolist()), (7, rng.standard_normal(3).tolist()), (40, [3.0] * 6), (60, [-3.0] * 6)]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in rows]


def best_pairs(rows, asked, k, of=lambda v: np.asarray(v)):
    want = {}
    for q in asked:
        best = {}
        for i, v in rows:
            for j, w in rows:
                if j == q != i and len(v) == len(w):
                    best[i] = max(best.get(i, -np.inf), (of(v) * of(w)).sum())
        want[q] = [(r + 1, i, best[i]) for r, i in enumerate(sorted(best, key=lambda i: (-best[i], i))[:k])]
    return want


def test_histogram_counts_an_id_with_different_vectors_once(spark, monkeypatch):
    from kestrel.llm import vector_grid

    data = several_vectors()
    want = best_pairs(data, (20, 40, 60), 5, lambda v: np.floor(np.asarray(v) * 256).astype(np.int64))
    rows, grid = table(spark, data), vector_grid.grid
    asked = rows.filter("vec_id in (20, 40, 60)")
    assert rows_of(histogram_topk.top_k(rows, asked, 5)) == want
    monkeypatch.setattr(histogram_topk, "grid", lambda a, b: grid(a, b, index_rows=50, query_rows=7))
    assert rows_of(histogram_topk.top_k(rows, asked, 5)) == want


def test_forest_counts_an_id_with_different_vectors_once(spark):
    data = several_vectors()
    rows = table(spark, data)
    got = rows_of(hash_forest.nearest(rows, rows.filter("vec_id in (20, 40, 60)"), 20, share=1.0))
    want = best_pairs(data, (20, 40, 60), 20)
    assert {q: [(r, i) for r, i, _ in x] for q, x in got.items()} == {q: [(r, i) for r, i, _ in x] for q, x in want.items()}
    assert all(s == pytest.approx(t, abs=1e-9) for q in want for (_, _, s), (_, _, t) in zip(got[q], want[q]))
    # The ascent asks for different ids: one id that fills most of the block does not end it.
    got = rows_of(hash_forest.nearest(rows, rows.filter("vec_id in (20, 40, 60)"), 20, share=0.3))
    assert all(len(got[q]) == 20 for q in (20, 40, 60))
