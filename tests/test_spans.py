"""Longest matches of gazetteer terms with offsets, against a plain search."""

import random

import numpy as np
import pytest

from kestrel.operators import spans

CHUNKS = "chunk_id string, chunk string"
GAZ = "term string, canonical string"


def brute(texts, gaz):
    names = {}
    for term, canonical in gaz:
        if term is not None and canonical is not None and spans.words(term)[0]:
            names.setdefault(tuple(spans.words(term)[0]), set()).add(canonical)
    top = max(map(len, names), default=0)
    out = []
    for key, text in texts:
        w, s = spans.words(text or "")
        i = 0
        while i < len(w):
            n = next((n for n in range(min(top, len(w) - i), 0, -1) if tuple(w[i : i + n]) in names), 0)
            if n:
                a, b = s[i], s[i + n - 1] + len(w[i + n - 1])
                out += [(key, a, b, text[a:b], " ".join(w[i : i + n]), c) for c in names[tuple(w[i : i + n])]]
            i += max(n, 1)
    return sorted(out, key=repr)


def found(spark, texts, gaz):
    rows = spans.location_spans(spark.createDataFrame(texts, CHUNKS).repartition(3), spark.createDataFrame(gaz, GAZ)).collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def planted():
    """Few words, so that terms are prefixes, suffixes and parts of each other; a long run of one word; a hot word."""
    r = random.Random(4)
    vocabulary = ["a", "b", "c", "New", "york", "CITY", "Zürich", "東京", "3"]
    gaz = [(" ".join(r.choices(vocabulary, k=r.randrange(1, 7))), f"n{i}") for i in range(60)]
    gaz += [("a", "first"), ("A!", "second"), ("a a a", "thrice"), ("new york", "NY"), ("York", "Y"), ("New-York City", "NYC"), (None, "x"), ("b", None), ("...", "dots")]
    texts = [(f"k{i}", "".join(r.choice(vocabulary + ["other"]) + r.choice([" ", ", ", "-", "\n", " … "]) for _ in range(r.randrange(0, 90)))) for i in range(150)]
    texts += [("run", "a " * 3001), ("empty", ""), ("null", None), (None, "New York City"), ("twice", "york, York"), ("twice", "york, York"), ("twice", "a"), ("marks", " .; ")]
    return texts, gaz


def test_as_plain_search(spark, planted):
    texts, gaz = planted
    got = found(spark, texts, gaz)
    assert got == brute(texts, gaz)
    assert [g[5] for g in got if g[0] is None] == ["NYC"]


def test_shards_give_the_same(spark, planted, monkeypatch):
    texts, gaz = planted
    monkeypatch.setattr(spans, "SHARD_BYTES", 100)
    assert found(spark, texts, gaz) == brute(texts, gaz)


def test_small_slices_and_pieces(planted, monkeypatch):
    texts, gaz = planted
    terms = sorted({" ".join(spans.words(t)[0]) for t, c in gaz if t and c} - {""})
    automaton = spans.Automaton.load(spans.Automaton.of_terms(terms).dump())
    monkeypatch.setattr(spans, "PIECE_WORDS", 1)
    monkeypatch.setattr(spans, "SLICE_CHARS", 50)
    rows = [r for part in spans._matches(automaton, [t for _, t in texts], True) for r in part.itertuples(index=False)]
    got = {(texts[r.at][0], r.span_start, r.span_end, r.surface, r.term) for r in rows}
    assert got == {x[:5] for x in brute(texts, gaz)}


def test_leftmost_chain():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 400):
        begins = np.sort(r.choice(1000, n, replace=False))
        ends = begins + r.integers(1, 30, n)
        want, end = [], 0
        for b, e in zip(begins, ends):
            want.append(bool(b >= end))
            end = e if b >= end else end
        assert spans.leftmost(begins, ends).tolist() == want


def test_empty_tables(spark):
    assert found(spark, [("k", "new york")], []) == []
    assert found(spark, [], [("york", "Y")]) == []
    clash = spark.createDataFrame([("york", "k", 1, "x")], "text string, key string, span_start int, canonical string")
    rows = spans.location_spans(clash, spark.createDataFrame([("york", "Y")], GAZ), "text", "key").collect()
    assert [tuple(r) for r in rows] == [("k", 0, 4, "york", "york", "Y")]
