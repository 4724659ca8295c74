"""Web pages as blocks of text, and their main text: the blocks that do not repeat over the pages of a host.

``page_blocks`` reads a page as a browser's tokenizer does (quoted attribute values, comments, raw-text elements, tags that
are never closed), in time linear in its length, and cuts its text at block-level elements.  ``main_text`` counts the hashes
of blocks per host with one combinable aggregate and leaves out those on many of the host's pages: menus, banners, footers.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import bounded_batches, materialize

# Fixed values of HTML: the elements that begin and end a block, those whose end is implied by the next of their kind,
# and those whose content is not text of the page.
BLOCK_ELEMENTS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
IMPLIED_END = frozenset("dd dt li option td th tr".split())
RAW_ELEMENTS = frozenset("iframe noembed noframes noscript script style svg template textarea title".split())
VOID_BLOCKS = frozenset(["hr"])

SALTS = 16  # a host's repeated blocks are looked up in so many places

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[=>]")
_VALUE = re.compile(r"""\s*(?:"[^"]*+"|'[^']*+'|(?P<open>["'])|[^\s>]*+)""")
_COMMENT_END = re.compile(r"--!?>")
_CLOSER = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW_ELEMENTS}
_ZEROS = re.compile(r"(?<=&#)0+(?=[0-9])|(?<=&#[xX])0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")


def _decoded(text: str) -> str:
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub("", text))
    return entities.unescape(text) if "&" in text else text


def _tag_end(page: str, at: int) -> int:
    """The place behind the ``>`` that ends a tag whose name ends at ``at``; -1 if none does."""
    while True:
        stop = _STOP.search(page, at)
        if stop is None:
            return -1
        if stop.group() == ">":
            return stop.end()
        value = _VALUE.match(page, stop.end())
        if value["open"]:
            return -1
        at = value.end()


def page_blocks(page: str | None) -> list[tuple[str, str]]:
    """``(kind, text)`` of a page's blocks in order; its title, if any, first with the kind ``title``.

    The kind is the innermost open block-level element (``text`` outside any).  Entities are decoded once, white space is
    collapsed, empty blocks are left out.  What follows a comment, a raw-text element or a quoted value
    that never ends belongs to it and is not text.  Null gives no blocks.
    """
    blocks: list[tuple[str, str]] = []
    title: str | None = None
    held: list[str] = []
    stack: list[str] = []
    opened: Counter[str] = Counter()

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append((stack[-1] if stack else "text", text))

    page = page or ""
    at = 0
    while 0 <= at < len(page):
        tag = page.find("<", at)
        if tag != at:
            held.append(_decoded(page[at : tag if tag >= 0 else len(page)]))
        if tag < 0:
            break
        after = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            if page.startswith((">", "->"), tag + 4):
                at = page.find(">", tag) + 1
            else:
                end = _COMMENT_END.search(page, tag + 4)
                at = end.end() if end else -1
            continue
        closing = after == "/"
        name_at = _NAME.match(page, tag + 1 + closing)
        if name_at is None:
            if after and after in "!?/":
                at = page.find(">", tag + 2) + 1 or -1
            else:
                held.append("<")
                at = tag + 1
            continue
        at = _tag_end(page, name_at.end())
        if at < 0:
            break
        name = name_at.group().lower()
        if closing:
            if name in BLOCK_ELEMENTS:
                flush()
                if opened[name]:
                    while True:
                        gone = stack.pop()
                        opened[gone] -= 1
                        if gone == name:
                            break
        elif name in RAW_ELEMENTS:
            if name == "svg" and page[at - 2] == "/":
                continue
            end = _CLOSER[name].search(page, at)
            if name == "title" and title is None:
                title = " ".join(_decoded(page[at : end.start() if end else len(page)]).split())
            at = _tag_end(page, end.end()) if end else -1
        elif name in BLOCK_ELEMENTS:
            flush()
            while stack and (stack[-1] == "p" or (stack[-1] == name and name in IMPLIED_END)):
                opened[stack.pop()] -= 1
            if name not in VOID_BLOCKS:
                stack.append(name)
                opened[name] += 1
        elif name == "br":
            held.append(" ")
    flush()
    return ([("title", title)] if title else []) + blocks


def blocks_of(pages: DataFrame, html_col: str = "html", out_col: str = "blocks") -> DataFrame:
    """Adds ``out_col``: the page's blocks as an array of ``kind, text``."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def cut(htmls: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t} for k, t in page_blocks(h)] for h in htmls], dtype=object)

    return pages.withColumn(out_col, cut(F.col(html_col)))


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 3, min_share: float = 0.5
) -> DataFrame:
    """One row per page: ``id_col, url_col, title, content, n_blocks, n_repeated``.

    A block (title aside) repeats if its text stands on at least ``min_pages`` pages of its host and on ``min_share`` of them.  ``content`` is
    the other blocks, a line each; a page all of whose blocks repeat keeps them all (``n_repeated`` is then 0), so
    copies of a whole page stay pages with their text.  Pages without a host in their URL keep every block; a page
    without text has empty content, one without a title an empty title.  Repeated rows and ids each have their row.

    A host has at most ``blocks a page / min_share`` repeated blocks.  Counts are combined before they are shuffled; a host with a third of
    all pages is looked up through salted copies of its repeated blocks, and pages are put together again by a stored row number.
    """
    bounded_batches(pages.sparkSession)  # a batch of pages and its blocks are in a worker's memory
    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    parsed = blocks_of(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("address"), host.alias("host"), F.col(html_col).alias("page")), "page")
    has_title = F.get("blocks", F.lit(0))["kind"] == "title"
    body = F.when(has_title, F.slice("blocks", 2, F.greatest(F.size("blocks"), F.lit(1)))).otherwise(F.col("blocks"))
    title = F.when(has_title, F.get("blocks", F.lit(0))["text"]).otherwise(F.lit(""))
    stored = materialize(parsed.select(F.monotonically_increasing_id().alias("row"), "id", "address", "host", title.alias("title"), body.alias("blocks")), "page-blocks")

    hosted = stored.where("host is not null and host <> ''")
    on_host = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.array_distinct(F.transform("blocks", lambda b: F.xxhash64(b["text"])))
    seen = hosted.select("host", F.explode(hashes).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    repeated = seen.join(on_host, "host").where(F.col("n") >= F.lit(min_share) * F.col("pages")).select("host", "hash")
    repeated = materialize(repeated, "repeated-blocks").select("host", "hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("again"))

    each = stored.select("row", "id", "address", "host", "title", F.posexplode_outer("blocks").alias("at", "block"))
    each = each.select("row", "id", "address", "host", "title", "at", F.col("block.text").alias("text"), F.xxhash64("block.text").alias("hash"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    marked = each.join(repeated, ["host", "hash", "salt"], "left")
    block = F.when(F.col("at").isNotNull(), F.struct("at", "text", F.coalesce("again", F.lit(False)).alias("again")))
    whole = marked.groupBy("row", "id", "address", "title").agg(F.array_sort(F.collect_list(block)).alias("blocks"))  # one page's blocks
    fresh = F.filter("blocks", lambda b: ~b["again"])
    kept = whole.withColumn("kept", F.when(F.size(fresh) > 0, fresh).otherwise(F.col("blocks")))
    return kept.select(
        F.col("id").alias(id_col),
        F.col("address").alias(url_col),
        "title",
        F.array_join(F.transform("kept", lambda b: b["text"]), "\n").alias("content"),
        F.size("blocks").alias("n_blocks"),
        (F.size("blocks") - F.size("kept")).alias("n_repeated"),
    )
