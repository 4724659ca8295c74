"""Pages as blocks, and their main text, against the standard library's parser and a plain count."""

import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from __spark_entry__ import queries
from kestrel.sources import html_blocks as hb
from tests.conftest import SF_CHECK, SF_SMALL


class Plain(HTMLParser):
    """Text of block elements by the standard library's tokenizer."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.skip, self.title = [], "", None, None
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        if self.held.split():
            self.out.append(" ".join(self.held.split()))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if self.skip is None and tag in hb.RAW_ELEMENTS:
            self.skip, self.kept, self.held = tag, self.held, ""
        elif self.skip is None and tag in hb.BLOCK_ELEMENTS:
            self.cut()
        elif tag == "br":
            self.held += " "

    def handle_endtag(self, tag):
        if self.skip == tag:
            if tag == "title" and self.title is None:
                self.title = " ".join(self.held.split())
            self.skip, self.held = None, self.kept
        elif self.skip is None and tag in hb.BLOCK_ELEMENTS:
            self.cut()

    def handle_data(self, data):
        self.held += data


def host(url):
    m = re.match(r"[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", (url or "").lower())
    return m.group(1) if m else None


def plain_main_text(rows, parse, min_pages=3, min_share=0.5):
    """``(id, url, title, content, n_blocks, n_repeated)`` by counting whole texts."""
    parsed = [(i, u, *parse(h)) for i, u, h in rows]
    on_host, seen = Counter(host(u) for _, u, _, _ in parsed), defaultdict(int)
    for _, u, _, blocks in parsed:
        for b in set(blocks):
            seen[host(u), b] += 1
    out = []
    for i, u, title, blocks in parsed:
        h = host(u)
        fresh = [b for b in blocks if not (h and seen[h, b] >= min_pages and seen[h, b] >= min_share * on_host[h])] or blocks
        out.append((i, u, title, "\n".join(fresh), len(blocks), len(blocks) - len(fresh)))
    return sorted(out, key=repr)


def by_blocks(page):
    blocks = hb.page_blocks(page)
    title = blocks.pop(0)[1] if blocks and blocks[0][0] == "title" else ""
    return title, [t for _, t in blocks]


def by_parser(page):
    p = Plain(page or "")
    return p.title or "", p.out


@pytest.mark.parametrize("folder", [SF_SMALL, SF_CHECK])
def test_query_against_plain_count(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(map(tuple, queries()["page_main_text"](spark, folder).collect()), key=repr)
    assert got == plain_main_text(rows, by_parser)
    assert any(r[5] for r in got) or folder == SF_SMALL


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        (None, []),
        ("a < b & c", [("text", "a < b & c")]),
        ('<p title="1 > 0">x</p>y', [("p", "x"), ("text", "y")]),
        ("<p title='\"' data-a = \"it's > that\" b=c/d>x", [("p", "x")]),
        ("<div>one<p>two<p>three<div>four</div>five</div>six", [("div", "one"), ("p", "two"), ("p", "three"), ("div", "four"), ("div", "five"), ("text", "six")]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]),
        ("<noscript><p>Turn it on</p></noscript><p>x", [("p", "x")]),
        ("<TITLE>T &amp;amp; <b>U</TITLE ><title>second</title><p>x", [("title", "T &amp; <b>U"), ("p", "x")]),
        ("<script>if (a</b) '</scripty>'</script>x", [("text", "x")]),
        ("a<!-- > <p>no -->b<!-->c<!--->d<!doctype q>e<?xml?>f</>g</ 1>h", [("text", "abcdefgh")]),
        ("a<!-- never closed <p>b", [("text", "a")]),
        ('<p>a</p><p class="never closed>b</p><p>c', [("p", "a")]),
        ("a<script>never closed", [("text", "a")]),
        ("a<b", [("text", "a")]),
        ("x<b>y</b>z<br>w&nbsp; &#8217;&#x2019;&#0000000065;", [("text", "xyz w ’’A")]),
        ("&#" + "9" * 9000 + ";<svg><title>no</title></svg><svg/>yes", [("text", "�yes")]),
        ("</div></p>a<hr>b</section>c", [("text", "a"), ("text", "b"), ("text", "c")]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", [("td", "1"), ("td", "2"), ("th", "3")]),
    ],
)
def test_tokenizer(page, want):
    assert hb.page_blocks(page) == want


@pytest.mark.parametrize("unit", ["<", "<p", "<p a='", "<p a=\"x\" ", "<!--", "<!", "</", "<div>", "</p>", "<p>", "<script>", "&#", "&", "=\"", "<svg><title>", "<li>a"])
def test_time_is_linear(unit):
    begin = time.process_time()
    hb.page_blocks(unit * (600_000 // len(unit)))
    assert time.process_time() - begin < 5


def test_edge_rows(spark):
    menu = "<nav>Home</nav>"
    rows = [(i, f"https://User@Hot.example:80/{i}", f"{menu}<p>text {i}</p><p>{'shared' if i < 5 else 'own'}</p>") for i in range(12)]
    rows += [(50 + i, "http://copies.example/", f"{menu}<p>the same page</p>") for i in range(4)]  # all blocks repeat: kept
    rows += [(60 + i, "http://one.example/x", menu) for i in range(5)]  # pages of one block
    rows += [(70, "http://few.example", menu), (71, "http://few.example?a", menu + "<p>a")]  # under three pages
    rows += [(80, None, menu), (81, "no host", menu), (82, None, None), (None, "http://hot.example/", menu + "<p>null id"), (1, "https://hot.example/1", ""), (1, "https://hot.example/1", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as row", "'x' as blocks", "'y' as host")
    got = sorted(map(tuple, hb.main_text(df).collect()), key=repr)
    assert got == plain_main_text(rows, by_blocks)
    content = {(r[0], r[1]): (r[3], r[5]) for r in got}
    assert content[3, "https://User@Hot.example:80/3"] == ("text 3\nshared", 1)
    assert content[50, "http://copies.example/"] == ("Home\nthe same page", 0) and content[60, "http://one.example/x"] == ("Home", 0)
    assert hb.main_text(df.limit(0)).collect() == []


def test_batches_of_whole_texts_are_bounded(spark):
    from kestrel.session import ARROW_BYTES, ARROW_ROWS

    from kestrel.sources.html_blocks import main_text

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>text {i}") for i in range(1000)], "page_id long, url string, html string").coalesce(1)
    make = lambda: main_text(pages)
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "10000"), spark.conf.unset(names[1])
        assert make().count() == 1000
        assert int(spark.conf.get(names[0])) <= ARROW_ROWS and int(spark.conf.get(names[1]).removesuffix("b")) <= ARROW_BYTES
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
