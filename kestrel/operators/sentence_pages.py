"""Pages of bounded length that end between sentences wherever they can.

Abbreviations are learned from the texts themselves: how often each word is followed by a period is one combinable
aggregate, and the log-likelihood ratio of Kiss and Strunk (2006), with its factors for length, inner
periods and occurrences without a period, tells abbreviations from words that end sentences.  The breaks of a text
are then an exact optimum (dynamic programming over its word gaps, linear by a sliding minimum), found in the
task that reads the text; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import PAGE_LENGTH, PAGE_OVERLAP
from kestrel.operators.enrich import non_blank
from kestrel.session import bounded_batches, materialize

# Fixed values of the published method: probability of a period after an abbreviation, and the least score of one.
PERIOD_AFTER_ABBREVIATION = 0.99
LEAST_SCORE = 0.3
MIN_SHARE = 1e-5  # of all words before a period; so there are at most 100,000 abbreviations

_WORD = r"(\p{L}+(?:\.\p{L}+)*+\.?)"  # possessive: walked without recursion in the JVM
_END = re.compile(r"(?<![.!?…])(?P<mark>[.!?…]++)[\"'”’»)\]]*+\s+|[。！？]+[」』”’]*\s*|\n[ \t\r]*\n\s*")
_BEFORE = regex.compile(r"\p{L}+(?:\.\p{L}+)*$")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
_GAP = re.compile(r"\s+")


def abbreviations(docs: DataFrame, text_col: str = "content", min_share: float = MIN_SHARE) -> DataFrame:
    """``word, n_period, n_plain, score`` of the words that are abbreviations: lower case, without the last period.

    Only words that make up ``min_share`` of all words before a period are listed, which bounds the list by
    ``1 / min_share`` whatever the number of texts.  Null texts count for nothing.
    """
    seen = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(_WORD), F.lit(1))).alias("w"))
    period = F.col("w").endswith(".")
    word = F.lower(F.when(period, F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")))
    counts = seen.groupBy(word.alias("word")).agg(F.count_if(period).alias("n_period"), F.count_if(~period).alias("n_plain"))
    counts = materialize(counts, "word-counts")  # read for the totals and for the scores: the texts are read once
    totals = counts.agg(F.sum("n_period").alias("periods"), F.sum(F.col("n_period") + F.col("n_plain")).alias("words")).first()
    periods, words = totals["periods"] or 0, totals["words"] or 0
    if not periods or periods == words:
        p = 0.5  # no counter-evidence to weigh a word against
    else:
        p = periods / words
    log = lambda k, q: k * F.log(F.lit(q))
    a, b = F.col("n_period"), F.col("n_plain")
    ratio = 2 * (log(a, PERIOD_AFTER_ABBREVIATION) + log(b, 1 - PERIOD_AFTER_ABBREVIATION) - log(a, p) - log(b, 1 - p))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -b)
    out = counts.where(a >= F.greatest(F.lit(1.0), F.lit(min_share * periods))).withColumn("score", score)
    return out.where(F.col("score") >= LEAST_SCORE)


def sentence_starts(text: str, abbreviated: frozenset[str] | set[str]) -> list[int]:
    """Places where a sentence after the first begins.  A sentence ends at ``.!?…`` before white space, at an East Asian full
    stop or at a blank line; not at the period of an abbreviation, and not where a small letter follows."""
    out = []
    reach = 1 + max(map(len, abbreviated), default=0)  # no abbreviation is longer, so no more is looked at
    for m in _END.finditer(text):
        at = m.end()
        if at >= len(text):
            continue
        if m["mark"] is not None and not _BLANK_LINE.search(m.group()):
            before = _BEFORE.search(text[max(0, m.start() - reach) : m.start()]) if m["mark"] == "." else None
            if text[at].islower() or (before and before.group().lower() in abbreviated):
                continue
        out.append(at)
    return out


def page_breaks(text: str, size: int, overlap: int, abbreviated: frozenset[str] | set[str]) -> list[tuple[int, int]]:
    """``(start, end)`` of the pages: no page longer than ``size``, each beginning at most ``overlap`` before the end of the one
    before, and together the whole text.

    A page begins at the first sentence that begins in that stretch, else at its first word, else ``overlap`` before.  Of all
    such plans the one with the fewest ends inside words, then the fewest inside sentences, then the fewest
    pages is taken; of equal ones that with later breaks, the last break first.
    """
    n = len(text)
    if n <= size:
        return [(0, n)]
    sentences = sentence_starts(text, abbreviated)
    gaps = [m.end() for m in _GAP.finditer(text) if 0 < m.end() < n]
    kinds = dict.fromkeys(gaps, 1)
    last = 0
    for g in [*gaps, n]:  # only a stretch that no page can step over may be cut inside a word
        if g - last > size - overlap:
            kinds.update(dict.fromkeys(range(last + 1, g), 2))
        last = g
    kinds.update(dict.fromkeys(sentences, 0))
    ends = sorted(kinds)
    price = (1, n + 2, (n + 2) ** 2)

    begins, i, j = [], 0, 0
    for e in ends:
        while i < len(sentences) and sentences[i] < e - overlap:
            i += 1
        while j < len(gaps) and gaps[j] < e - overlap:
            j += 1
        if i < len(sentences) and sentences[i] <= e:
            begins.append(sentences[i])
        else:
            begins.append(gaps[j] if j < len(gaps) and gaps[j] <= e else max(0, e - overlap))

    # best[x]: cheapest way to end a page at ends[x]; open: those that a next page can start from, cheapest first.
    best, before = [], []
    window: deque[int] = deque([-1])
    cost = lambda x: 0 if x < 0 else best[x]
    for x, e in enumerate([*ends, n]):
        while (0 if window[0] < 0 else begins[window[0]]) + size < e:
            window.popleft()
        before.append(window[0])
        best.append(cost(window[0]) + 1 + (price[kinds[e]] if e < n and kinds[e] else 0))
        while window and cost(window[-1]) >= best[x]:
            window.pop()
        window.append(x)
    out, x, end = [], before[-1], n
    while x >= 0:
        out.append((begins[x], end))
        x, end = before[x], ends[x]
    out.append((0, end))
    return out[::-1]


def sentence_pages(docs: DataFrame, text_col: str = "content", size: int = PAGE_LENGTH, overlap: int = PAGE_OVERLAP) -> DataFrame:
    """One row per page of each non-blank document: the other columns, ``page`` (from 0), ``page_start`` (characters before it) and
    ``chunk``, cut as ``page_breaks`` says with the abbreviations of these documents.

    Null and blank texts have no rows; repeated rows each have their own pages; a text of any length is cut whole.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap is shorter than a page")
    bounded_batches(docs.sparkSession)  # a batch of texts and its pages are in a worker's memory
    learned = frozenset(r["word"] for r in abbreviations(docs, text_col).select("word").collect())  # at most 1 / MIN_SHARE words
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("array<struct<page_start:int,chunk:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"page_start": s, "chunk": t[s:e]} for s, e in page_breaks(t, size, overlap, shared.value)] for t in texts], dtype=object)

    keep = [c for c in docs.columns if c != text_col]
    pages = docs.where(non_blank(F.col(text_col))).select(*keep, F.posexplode(cut(F.col(text_col))).alias("page", "cut_page"))
    return pages.select(*keep, "page", F.col("cut_page.page_start").alias("page_start"), F.col("cut_page.chunk").alias("chunk"))
