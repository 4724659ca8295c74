"""Block-max keyword search against plain BM25 over all chunks."""

import math
import random
import re
from collections import Counter

import pytest

from kestrel.operators import postings, retrieve


def brute(chunks, queries, k):
    toks = {key: re.findall(r"\w+", text.lower()) for key, text in chunks}
    n, avgdl = len(toks), sum(map(len, toks.values())) / max(1, len(toks))
    df = Counter(w for t in toks.values() for w in set(t))
    out = []
    for q, text in queries:
        scores = {}
        for key, t in toks.items():
            tf = Counter(t)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) for w in set(text.lower().split()) if tf[w])
            if s > 0:
                scores[key] = round(s, 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, key, s, r) for r, (key, s) in enumerate(best, 1)]
    return sorted(out)


def collected(df):
    return sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in df.collect())


def same(got, want):
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    chunks = [(f"c{i:04d}", " ".join(["hot"] * (i % 3 == 0) + r.choices(words, weights, k=r.randrange(1, 60)))) for i in range(1500)]
    chunks += [("empty", ""), ("blank", " . ,"), ("copy1", "w200 w201 w202"), ("copy2", "w200 w201 w202")]
    queries = [(i, " ".join(r.choices(words, k=r.randrange(1, 25)))) for i in range(40)] + [(100, "hot"), (101, "hot w0 w1"), (102, "unknown"), (103, ""), (104, "w200 w201 w202 w202"), (105, "unknown w7")]
    return chunks, queries, spark.createDataFrame(chunks, "chunk_id string, chunk string").repartition(3), spark.createDataFrame(queries, "query_id long, query_text string")


@pytest.mark.parametrize("k", [1, 5, 50])
def test_same_rows_as_brute_force(corpus, k):
    chunks, queries, index, asked = corpus
    p = postings.build_postings(index)
    same(collected(postings.search(p, asked, k)), brute(chunks, queries, k))


def test_parts_and_small_blocks(corpus, monkeypatch):
    """A hot term in many parts; blocks of four postings."""
    chunks, queries, index, asked = corpus
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "PART_CHUNKS", 200)
    p = postings.build_postings(index)
    hot = p.blocks.where("term = 'hot'")
    assert hot.select("part").distinct().count() == 8 and hot.selectExpr("max(n)").first()[0] <= 4
    assert all(r["impacts"] == sorted(r["impacts"], reverse=True) and r["impacts"][0] == r["largest"] for r in hot.collect())
    same(collected(postings.search(p, asked, 5)), brute(chunks, queries, 5))
    one = asked.where("query_id = 100")
    assert postings.share_read(p, one, 5) < 0.2  # a single frequent term: only its first blocks


def test_search_is_that_of_the_scan(corpus):
    _, _, index, asked = corpus
    same(collected(postings.search(postings.build_postings(index), asked, 7)), collected(retrieve.keyword_search(index, asked, 7)))


def test_empty_index_and_queries(spark, corpus):
    _, _, index, asked = corpus
    none = spark.createDataFrame([], "chunk_id string, chunk string")
    assert postings.search(postings.build_postings(none), asked, 5).collect() == []
    assert postings.search(postings.build_postings(index), asked.limit(0), 5).collect() == []


def test_counts_of_a_text_stay_in_its_row(spark, corpus):
    """Postings are packed per chunk: no posting is a row of a shuffle before its part is put in blocks."""
    from pyspark.sql import functions as F

    from kestrel.functions.text import term_counts, tokens
    from kestrel.operators import kb_function as KB

    df = spark.createDataFrame([("b a B",), ("",), (None,)], "s string").select(term_counts(tokens("s")).alias("c"))
    assert [tuple(map(tuple, r["c"])) for r in df.collect()] == [(("b", "a"), (2, 1)), ((), ()), ((), ())]
    chunks, _, index, _ = corpus
    packed = KB.build_postings(index)
    assert packed.columns == ["chunk_id", "dl", "terms", "tfs"] and packed.count() == len(chunks)
    twice = KB.build_postings(index.unionByName(index)).where("chunk_id = 'copy1'").first()
    assert sorted(zip(twice["terms"], twice["tfs"])) == [("w200", 2), ("w201", 2), ("w202", 2)] and twice["dl"] == 3
    p = postings.build_postings(index)
    assert p.chunks.count() == len(chunks) - 2 and "tfs" in p.chunks.columns
    assert p.blocks.agg(F.sum("n")).first()[0] == p.chunks.agg(F.sum(F.size("terms"))).first()[0]


def test_function_index_has_a_row_a_part_and_term(spark, monkeypatch):
    """A word of every chunk is a few rows, not one a posting; scores are those of brute force, also with copies, repeated keys,
    and parts that end between keys."""
    from kestrel.operators import kb_function as KB

    monkeypatch.setattr(KB, "PART_CHUNKS", 16)
    rows = [(f"k{i:03d}", "the " + " ".join(f"w{(i * j) % 17}" for j in range(1, 2 + i % 7)), "t", "u") for i in range(120)]
    rows += [("k007", "the w1 twice w3", "t", "u"), ("k900", "...", "t", "u")]  # a key with two texts, a chunk without words
    index = spark.createDataFrame(rows, "chunk_id string, chunk string, title string, source_url string")
    views = KB.store_inverted_index(spark, index)
    per = spark.table(views["postings"]).where("term = 'the'")
    assert per.count() <= 120 / 16 + 4 * 2 and per.select("chunk_id_part").distinct().count() == per.count() > 1
    asked = {1: "the w3 w5 nothing", 2: "W16 w16 twice", 3: "nothing", 4: ""}
    fn = KB.register_search_function(spark, views, top=5)
    got = KB.search_with_function(spark, spark.createDataFrame(list(asked.items()), "query_id long, query_text string"), fn)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in got.collect()}
    words = [(k, re.findall(r"[^\W_]+", t.lower())) for k, t, *_ in rows]
    n, avgdl = len(words), sum(len(w) for _, w in words) / len(words)
    expected = {}
    for q, text in asked.items():
        score = Counter()
        for t in set(re.findall(r"\w+", text.lower())):
            df = sum(t in w for _, w in words)
            for k, w in words:
                if t in w:
                    score[k] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avgdl))
        for rank, (k, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5], 1):
            expected[q, rank] = (k, pytest.approx(s, abs=1e-6))
    assert got == expected and len(got) == 10
