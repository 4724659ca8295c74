"""Text expressions: tokens, page windows, keys, hashed vectors, HTML cracking."""

import base64
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from kestrel.functions import text as TX
from kestrel.operators import enrich
from kestrel.operators.ground import citation_ref, decode_citation_ref
from kestrel.sources import io


def _pages(text, size=2000, overlap=500):
    n = max(1, math.ceil((len(text) - overlap) / (size - overlap)))
    return [text[i * (size - overlap): i * (size - overlap) + size] for i in range(n)]


def test_chunk_windows_edge_lengths(spark):
    texts = ["", "   ", "a", "x" * 1999, "y" * 2000, "z" * 2001, "w" * 3500, "v" * 3501, "é€𝄞" * 900, "ab\ncd " * 700]
    docs = spark.createDataFrame([(i, t, f"{i}.txt", f"https://h/{i}") for i, t in enumerate(texts)], "doc_id long, content string, file_name string, source_url string")
    got = {}
    for r in enrich.chunk_text(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["page"], r["chunk"]))
    for i, t in enumerate(texts):
        if not t.strip(" "):
            assert i not in got  # blank documents are dropped
            continue
        want = _pages(t)
        assert [c for _, c in sorted(got[i])] == want, i
    assert len(got[4]) == 1 and len(got[5]) == 2  # 2000 -> 1 page, 2001 -> 2


def test_overlapping_pages_rebuild_text(spark):
    t = "".join(chr(97 + (i * 7) % 26) for i in range(9000))
    docs = spark.createDataFrame([(1, t, "1.txt", "u")], "doc_id long, content string, file_name string, source_url string")
    pages = [r["chunk"] for r in enrich.chunk_text(docs).orderBy("page").collect()]
    rebuilt = pages[0] + "".join(p[500:] for p in pages[1:])
    assert rebuilt == t


def test_tokens(spark):
    row = spark.createDataFrame([("Héllo, WORLD -- x2 ,,",)], "t string").select(TX.tokens(F.col("t")).alias("k")).first()
    assert row["k"] == ["héllo", "world", "x2"]


def test_chunk_key_shape_and_roundtrip(spark):
    urls = ["https://store.example/src1/1.txt", "http://a.b/ü?x=1&y=2", "https://x.example/" + "p" * 120]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, page int")
    rows = df.select("url", "page", TX.chunk_key(F.col("url"), F.col("page")).alias("k"),
                     *[c.alias(n) for c, n in zip(decode_citation_ref(citation_ref(F.col("url"), F.col("page"))), ["u2", "p2"])]).collect()
    for r in rows:
        hexpart, rest = r["k"].split("_", 1)
        assert hexpart == hashlib.sha256(r["url"].encode()).hexdigest()[:12]
        b64 = base64.urlsafe_b64encode(r["url"].encode()).decode().rstrip("=")
        assert rest == f"{b64}_pages_{r['page']}"
        assert "\n" not in r["k"] and "\r" not in r["k"]
        assert (r["u2"], r["p2"]) == (r["url"], str(r["page"]))


def test_hashed_embedding_matches_numpy(spark):
    texts = ["the cat the dog", "", "!!!", "Ünïcode wörds and more words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", TX.hashed_embedding(F.col("t"), 16).alias("v")).collect()}
    import re

    for i, t in enumerate(texts):
        toks = [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
        counts = np.zeros(16)
        for w in toks:
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        n = np.sqrt((counts ** 2).sum())
        want = (counts / n if n else counts).astype(np.float32)
        assert np.array_equal(np.array(got[i], dtype=np.float32), want), (i, got[i], want)


def test_html_text_and_title(spark):
    html = '<html><head><title> A &amp; B </title><style>p{}</style><script>var t="</p>";</script></head><body><p>Hi&nbsp;there</p>\n<div>x &lt; y</div></body></html>'
    r = io.page_text_extract(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert r["title"] == "A & B"
    assert r["content"] == "Hi there x < y"


def test_html_comments_and_entities(spark):
    cases = {
        "<!-- x > y --><p>a</p>": "a",
        "a &mdash; b &#8217; c &#x2019; d &apos; e": "a \u2014 b \u2019 c \u2019 d ' e",
        "&#128512;|&#x1F600;|&#0;|&#55296;": "\U0001f600|\U0001f600|\ufffd|\ufffd",
        "&amp;lt; &amp;#39;": "&lt; &#39;",
        "no &unknown; one, 5 &# 6": "no &unknown; one, 5 &# 6",
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r["h"]: r["t"] for r in df.select("h", TX.html_text(F.col("h")).alias("t")).collect()}
    assert got == cases


def test_counts_of_chosen_tokens(spark):
    from kestrel.functions.text import term_counts

    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c"]), (5, ["a"])], "id int, toks array<string>").coalesce(1)
    counts = lambda only: {r["id"]: dict(zip(r["c"]["terms"], r["c"]["tfs"])) for r in df.select("id", term_counts(F.col("toks"), only).alias("c")).collect()}
    assert counts(None) == {1: {"a": 1, "b": 2}, 2: {}, 3: {}, 4: {"c": 1}, 5: {"a": 1}}
    assert counts(spark.sparkContext.broadcast(frozenset(["b", "x"]))) == {1: {"b": 2}, 2: {}, 3: {}, 4: {}, 5: {}}
