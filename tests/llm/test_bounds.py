"""Cases in which rows were lost or changed by their size or their ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import language_id, line_quality, packing
from kestrel.llm.queries import tokenizer
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("size", [8, 40, 1000])
def test_long_lines_stay_one_line(monkeypatch, size):
    r = np.random.default_rng(size)
    words = ["A", "b,", "cc", "cc", "D!", "12", "#x", "  ", "\t", "\n", "\n\n", "\r\n", "é", "w" * 30]
    texts = ["", "\n", "x" * 500, " ".join(["same"] * 300)] + [" ".join(words[i] for i in r.integers(0, len(words), 200)) for _ in range(60)]
    whole = [line_quality.text_lines(t) for t in texts]
    monkeypatch.setattr(line_quality, "SLICE", size)
    for t, (x, n) in zip(texts, whole):
        x2, n2 = line_quality.text_lines(t)
        assert n.tolist() == n2.tolist() == [len(line.encode()) for line in t.replace("\r\n", "\n").split("\n")]
        np.testing.assert_allclose(x, x2)


def test_a_megabyte_line_is_one_line():
    assert [len(line_quality.text_lines("word " * k)[1]) for k in (200_000, 300_000, 700_000)] == [1, 1, 1]


def test_features_of_lines_by_hand():
    x, n = line_quality.text_lines("The the the CAT, 12\nThe the the CAT, 12\n\n!a# b!")
    assert n.tolist() == [19, 19, 0, 6]
    np.testing.assert_allclose(x[0, :11], [np.log1p(19) / 8, 12 / 19, 4 / 12, 2 / 19, 4 / 19, 0, 1 / 5, 0, 2 / 5, 0, min(1, 14 / 5 / 16)])
    assert x[1, 9] == 1 and x[2, 9] == 0  # a line like the one before it
    np.testing.assert_allclose(x[1, 11:22], x[0, :11])  # the line before
    np.testing.assert_allclose(x[1, 22:33], x[2, :11])  # the line after
    np.testing.assert_allclose(x[3, 5:8], [min(1, 4 * 3 / 6), 0, 1.0])
    assert x[:, -3].tolist() == [1, 0, 0, 0] and x[:, -2].tolist() == [0, 0, 0, 1] and (x[:, -1] == 1).all()


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(1)
    unary = [r.normal(size=n) for n in (1, 4, 9, 30)]
    trans = r.normal(size=(2, 2))
    good, pair = line_quality.blocked_forward_backward(unary, trans, cells=10)

    def log_z(u, t):
        return line_quality.forward_backward(u, t)[1].sum()

    for i, u in enumerate(unary):
        for j in range(len(u)):
            up = [v.copy() for v in unary]
            up[i][j] += 1e-5
            assert abs((log_z(up, trans) - log_z(unary, trans)) / 1e-5 - good[i][j]) < 1e-3
    for i in (0, 1):
        for j in (0, 1):
            t = trans.copy()
            t[i, j] += 1e-5
            assert abs((log_z(unary, t) - log_z(unary, trans)) / 1e-5 - pair[i, j]) < 1e-3


def test_score_is_the_length_weighted_share():
    model = line_quality.QualityModel(np.linspace(-1, 1, line_quality.N_FEATURES), np.array([[0.5, -0.2], [0.1, 0.3]]), 1.7, -0.4)
    texts = ["one line", "two\nlines here\n\nand more", "", None]
    for t, got in zip(texts, model.scores(texts)):
        x, n = line_quality.text_lines(t)
        good = line_quality.forward_backward([x @ model.weights], model.trans)[0][0]
        share = sum(g * (k + 1) for g, k in zip(good, n)) / sum(k + 1 for k in n)
        assert abs(got - 1 / (1 + np.exp(-(1.7 * np.log(share / (1 - share)) - 0.4)))) < 1e-9


def test_long_labelled_texts_are_learned_from(spark):
    good, bad = "A sentence of plain words goes here.\n", "#### !!!! $$$$ 0000 %%%%\n"
    rows = [(i, (good if i % 2 else bad) * 900, "en", "s", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    out = line_quality.score_quality(spark.createDataFrame(rows, DOCS).repartition(3), labels).collect()
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in out)


def test_sample_budget_and_equal_ids(spark):
    rows = [(i % 20, f"text {i} of words\n" * (1 + i % 3), "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    a, b = (line_quality.train(docs.repartition(n), labels, max_lines=12) for n in (1, 5))
    np.testing.assert_array_equal(a.weights, b.weights)  # which text of an id counts does not depend on the partitions
    c, d = (language_id.train(docs.repartition(n)) for n in (1, 5))
    np.testing.assert_array_equal(c.weights, d.weights)


def test_language_features_weights_and_bound(spark):
    """Counts, document frequencies and TF-IDF against plain loops; the number of languages is bounded."""
    text = "Abba"
    got = language_id.ngram_counts(text)
    assert got.sum() == 4 + 3 + 2
    assert (language_id.ngram_counts("ab") <= got).all() and not language_id.ngram_counts("").any()
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("eins zwei drei", "de"), ("one two three", "en"), ("eins vier", "de"), ("un deux", "fr")] * 6)]
    docs = spark.createDataFrame(rows, DOCS)
    df, n = language_id.document_frequencies(docs, "text")
    assert n == 24 and df.tolist() == sum((language_id.ngram_counts(r[1]) > 0).astype(int) for r in rows).tolist()
    assert language_id.train(docs, max_languages=1).labels == ["de"] and language_id.train(docs, max_languages=2).labels == ["de", "en"]


def test_ftrl_against_a_loop():
    """One feature vector after the other, coordinate by coordinate."""
    r = np.random.default_rng(3)
    rows = [(np.array([1, 5, language_id.BUCKETS]), r.normal(size=3)) for _ in range(7)]
    y = r.integers(0, 3, 7)
    got = language_id.fit_ftrl(rows, y, 3, alpha=0.5, beta=1.0, l1=0.01, l2=0.02, epochs=2, seed=4)
    z, n, order = {}, {}, np.random.default_rng(4)

    def weight(i, k):
        zi, ni = z.get((i, k), 0.0), n.get((i, k), 0.0)
        return 0.0 if abs(zi) <= 0.01 else -(zi - np.sign(zi) * 0.01) / ((1.0 + ni**0.5) / 0.5 + 0.02)

    for _ in range(2):
        for j in order.permutation(7):
            at, x = rows[j]
            w = {(i, k): weight(i, k) for i in at for k in range(3)}
            e = np.array([sum(v * w[i, k] for i, v in zip(at, x)) for k in range(3)])
            p = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            for i, v in zip(at, x):
                for k in range(3):
                    g = v * (p[k] - (y[j] == k))
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / 0.5 * w[i, k]
                    n[i, k] = old + g * g
    for i in (1, 5, language_id.BUCKETS):
        np.testing.assert_allclose(got[i], [weight(i, k) for k in range(3)])


def test_no_learnable_language(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["words", "12 !?", None, "", "Ж"])]
    kept = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, DOCS), SF_SMALL)
    assert sorted(r["text"] for r in kept.collect()) == ["words", "Ж"]


def test_rows_of_equal_ids_are_dealt_and_kept(spark, tmp_path):
    rows = [(None if i % 2 else 7, f"text number {i}", "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    out = packing.packed_matrix(docs, capacity=64, **tokenizer()).select(F.explode(F.arrays_zip("doc_ids", "pieces"))).count()
    assert out == 300
    packed = packing.pack_tightly(docs, capacity=64, **tokenizer())
    assert packed.count() == 300 and "row_number" not in packed.columns
    items = spark.createDataFrame([(i, 5) for i in range(1000)], "row_number long, length long").withColumn("doc_id", F.lit(None).cast("long"))
    placed, _ = packing.place(items, packing.minimum_bin_slack, 10, bucket_rows=50)
    assert placed.select("sequence_id", "offset").distinct().count() == 1000


def test_plain_texts_have_the_library_s_ids():
    from tokenizers import Tokenizer

    t = tokenizer()
    own, library = packing.Encoder(t["path"], t["ranks_path"], t["pattern"]), Tokenizer.from_file(t["path"])
    r = np.random.default_rng(11)
    chars = [chr(c) for c in range(256)]
    texts = ["".join(chars[c] for c in r.integers(0, 256, r.integers(1, 60))) for _ in range(4000)]
    few = " 'stlre\n\t a1.\xa0\x85é"
    texts += ["".join(few[c] for c in r.integers(0, len(few), r.integers(1, 80))) for _ in range(4000)]
    assert all(own.encode(x).tolist() == library.encode(x, add_special_tokens=False).ids for x in texts)
