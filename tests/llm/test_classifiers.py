"""Language ID and line quality: held-out accuracy, parts against brute force, edge tables."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import language_id, line_quality
from kestrel.llm.queries import QUERIES
from tests.conftest import SF_CHECK


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language_id"](spark, SF_CHECK).join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_never_sees_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    spoiled = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language_id.train(d) for d in (docs, spoiled))
    assert a.labels == b.labels and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_weights_are_sparse_and_slices_count_alike(monkeypatch):
    text = "Dies ist ein kurzer Text, ça va?" * 20
    whole = language_id.ngram_counts(text)
    assert whole.sum() == 3 * len(text) - 3
    for size in (1, 2, 3, 50):
        monkeypatch.setattr(language_id, "SLICE", size)
        assert (language_id.ngram_counts(text) == whole).all()
    rows = [(np.array([i % 7, 100 + i % 2]), np.ones(2)) for i in range(200)]
    w = language_id.fit_ftrl(rows, np.arange(200) % 2, 2, l1=0.5)
    assert (w[200:] == 0).all() and w[100, 0] > 0 > w[101, 0]


def test_temperature_lowers_the_log_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    logits = rng.standard_normal((500, 3)) * 0.5 + 1.0 * np.eye(3)[y]
    t = language_id.fit_temperature(10 * logits, y)
    # With unit signal and noise of variance 1/4 the right logits are 4 times the values, here given 10 times.
    assert 2 < t < 3 and language_id.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_language_edges(edge_docs, no_docs):
    rows = language_id.identify(edge_docs).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == edge_docs.count()
    for i in (2, 3, 4, 5):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[6]["lang_pred"] == "en" and all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    unknown = language_id.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
    assert language_id.identify(no_docs).count() == 0


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    rows = QUERIES["op8_crf_quality"](spark, SF_CHECK).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 30 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    unary = [rng.standard_normal(n) for n in (1, 4, 2, 6)]
    trans = rng.standard_normal((2, 2))
    good, log_z, pair = line_quality.forward_backward(unary, trans)
    total = np.zeros((2, 2))
    for u, g, z in zip(unary, good, log_z):
        paths = list(itertools.product((0, 1), repeat=len(u)))
        w = np.array([np.exp(sum(u[i] for i, s in enumerate(p) if s) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        assert np.isclose(np.log(w.sum()), z)
        assert np.allclose([sum(x for x, p in zip(w, paths) if p[i]) / w.sum() for i in range(len(u))], g)
        for x, p in zip(w / w.sum(), paths):
            for a, b in zip(p, p[1:]):
                total[a, b] += x
    assert np.allclose(total, pair)


def test_line_features():
    x, n = line_quality.text_lines("Good words here.\nsame same same same\n\nSHOUT!!! A### B$$$\nsame same same same\nsame same same same")
    assert n.tolist() == [16, 19, 0, 18, 19, 19]
    own = x[:, : line_quality.N_OWN]
    assert own[1, 6] == 0.75 and own[0, 6] == 0  # repeated words
    assert own[3, 7] == 1 and own[0, 7] == 0  # words that end in a sign
    assert own[:, 9].tolist() == [0, 0, 0, 0, 0, 1]  # equals the line before
    k = line_quality.N_OWN
    assert (x[1:, k : 2 * k] == own[:-1]).all() and (x[:-1, 2 * k : 3 * k] == own[1:]).all() and x[0, -3] == x[-1, -2] == 1


def test_long_texts_in_slices(monkeypatch):
    text = "Line one is here.\nLINE TWO!!\r\nthree three three\n" * 50
    whole, n = line_quality.text_lines(text)
    for size in (20, 333):
        monkeypatch.setattr(line_quality, "SLICE", size)
        x, m = line_quality.text_lines(text)
        assert (m == n).all()
        np.testing.assert_allclose(x, whole)
    monkeypatch.setattr(line_quality, "SLICE", 10)
    assert line_quality.text_lines("x" * 95 + "\nab")[1].tolist() == [95, 2]  # a line of many slices stays one line


@pytest.mark.parametrize("label_rows", [[(1, 1, 0), (6, 0, 0), (8, 1, 0), (9, 0, 1), (None, 1, 1), (5, None, 0), (7, 1, 0), (7, 0, 0)], []])
def test_quality_edges(spark, edge_docs, no_docs, label_rows):
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int")
    rows = line_quality.score_quality(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (2, 3)}
    assert len(same) == 1
    if not label_rows:
        assert all(r["score"] == pytest.approx(0.5) for r in rows)
    assert line_quality.score_quality(no_docs, labels).count() == 0
