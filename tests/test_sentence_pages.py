"""Pages that end between sentences: learned abbreviations, exact breaks, whole texts."""

import random
from functools import lru_cache

import pytest

from __spark_entry__ import queries
from kestrel.operators import sentence_pages as sp
from tests.conftest import SF_SMALL


def kind(text, starts, e):
    if e == len(text) or e in starts:
        return (0, 0)
    return (0, 1) if text[e - 1].isspace() and not text[e].isspace() else (1, 0)


def start_after(text, starts, e, overlap):
    low = max(0, e - overlap)
    for places in (starts, [g for g in range(1, len(text)) if text[g - 1].isspace() and not text[g].isspace()]):
        inside = [p for p in places if low <= p <= e]
        if inside:
            return min(inside)
    return low


def cheapest(text, size, overlap, abbreviated=frozenset()):
    """Least (cuts in words, cuts in sentences, pages) over breaks at any character."""
    starts = sp.sentence_starts(text, abbreviated)

    @lru_cache(maxsize=None)
    def rest(e):
        begin = 0 if e == 0 else start_after(text, starts, e, overlap)
        if begin + size >= len(text):
            done = [(0, 0, 1)]
        else:
            done = []
        for nxt in range(e + 1, min(begin + size, len(text) - 1) + 1):
            k, r = kind(text, starts, nxt), rest(nxt)
            done.append((k[0] + r[0], k[1] + r[1], 1 + r[2]))
        return min(done)

    return rest(0)


def paid(text, pages, abbreviated=frozenset()):
    starts = sp.sentence_starts(text, abbreviated)
    k = [kind(text, starts, e) for _, e in pages]
    return (sum(x[0] for x in k), sum(x[1] for x in k), len(pages))


def whole(text, pages, size, overlap):
    assert pages[0][0] == 0 and pages[-1][1] == len(text)
    assert all(0 < e - s <= size for s, e in pages)
    assert all(0 <= a[1] - b[0] <= overlap and b[1] > a[1] for a, b in zip(pages, pages[1:]))


def test_breaks_against_exhaustive_search():
    r = random.Random(9)
    for i in range(400):
        words = ["".join(r.choices("abcDE", k=r.choice([1, 2, 3, 5, 5, 25]))) + r.choice(["", "", "", ".", "!", "\n\n"]) for _ in range(r.randrange(1, 22))]
        text = r.choice([" ", "  "]).join(words)
        size = r.randrange(4, 40)
        overlap = r.randrange(0, size)
        pages = sp.page_breaks(text, size, overlap, frozenset())
        whole(text, pages, size, overlap)
        assert paid(text, pages) == cheapest(text, size, overlap), (text, size, overlap, pages)


def test_sentences_and_abbreviations():
    text = 'He met Dr. Ash. "Good day!" said she, e.g. Then?  yes... no. End.\n\nnext one. 終わり。次'
    starts = sp.sentence_starts(text, {"dr", "e.g"})
    assert [text[s:].split(" ")[0] for s in starts] == ['"Good', "End.\n\nnext", "next", "終わり。次", "次"]
    assert sp.sentence_starts("", set()) == [] and sp.sentence_starts("One. ", set()) == []


def test_learned_abbreviations(spark):
    r = random.Random(2)
    plain = [f"{w}{v}" for w in ("stone", "river", "garden", "window") for v in "abcdefgh"]
    rows = []
    for i in range(300):
        sentences = [" ".join(r.choices(plain, k=8)).capitalize() + " " + r.choice(["Dr. Ash", "e.g. " + r.choice(plain), "no. " + str(i), r.choice(plain)]) + " " + r.choice(plain) + "." for _ in range(6)]
        rows.append((i, " ".join(sentences)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "id long, content string")
    assert {x["word"] for x in sp.abbreviations(docs).collect()} == {"dr", "e.g", "no"}


def test_frames_with_any_columns(spark):
    docs = spark.createDataFrame([(1, "A b. " * 900, "p"), (1, "A b. " * 900, "p"), (2, None, "q"), (3, " ", "q"), (None, "short", None)], "page_no int, content string, cut_start string")
    pages = sp.sentence_pages(docs).collect()
    assert sorted(x["page"] for x in pages if x["page_no"] == 1) == sorted([0, 1, 2] * 2)
    assert [(x["page"], x["page_start"], x["chunk"]) for x in pages if x["page_no"] is None] == [(0, 0, "short")]
    assert {x["page_no"] for x in pages} == {1, None}
    assert sp.sentence_pages(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sp.sentence_pages(docs, size=10, overlap=10)


@pytest.mark.parametrize("text", ["a." * 60_000, "." * 120_000, '."' * 60_000, "\n" * 120_000, " " * 119_999 + "x", "。" * 120_000, "a. " * 40_000])
def test_long_texts_of_one_pattern(spark, text):
    """Time grows with the length, in the JVM and in the tasks."""
    pages = sp.sentence_pages(spark.createDataFrame([(1, text)], "id long, content string")).collect()
    whole(text, [(r["page_start"], r["page_start"] + len(r["chunk"])) for r in sorted(pages, key=lambda r: r["page"])], 2000, 500)


def test_long_text_without_gaps():
    text = "x" * 100_003
    pages = sp.page_breaks(text, 2000, 500, frozenset())
    whole(text, pages, 2000, 500)
    assert len(pages) == 1 + -(-(100_003 - 2000) // 1500)


def test_query_keeps_whole_texts_and_cuts_fewer_sentences(spark):
    """Every document is rebuilt from its pages; far fewer pages end inside a sentence than fixed windows do."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    short = frozenset(r["word"] for r in sp.abbreviations(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "text").collect())
    got = {}
    for r in queries()["sentence_pages"](spark, SF_SMALL).collect():
        got.setdefault(r["doc_id"], []).append((r["page"], r["page_start"], r["page_start"] + len(r["chunk"]), r["chunk"]))
    assert set(got) == {d for d, t in docs.items() if t and t.strip(" ")}
    cut = fixed = 0
    for d, pages in got.items():
        text, pages = docs[d], sorted(pages)
        assert [p[0] for p in pages] == list(range(len(pages))) and all(text[s:e] == c for _, s, e, c in pages)
        whole(text, [(s, e) for _, s, e, _ in pages], 2000, 500)
        starts = set(sp.sentence_starts(text, short))
        cut += sum(e not in starts and e < len(text) for _, _, e, _ in pages)
        fixed += sum(e not in starts for e in range(2000, len(text), 1500))
    assert fixed > 50 and cut < fixed / 4


def test_batches_of_whole_texts_are_bounded(spark):
    from kestrel.session import ARROW_BYTES, ARROW_ROWS

    from kestrel.operators.sentence_pages import sentence_pages

    docs = spark.createDataFrame([(i, "One. " * 3) for i in range(1000)], "doc_id long, content string").coalesce(1)
    make = lambda: sentence_pages(docs)
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "10000"), spark.conf.unset(names[1])
        assert make().count() == 1000
        assert int(spark.conf.get(names[0])) <= ARROW_ROWS and int(spark.conf.get(names[1]).removesuffix("b")) <= ARROW_BYTES
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
