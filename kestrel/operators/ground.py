"""Grounding: hits -> formatted sources -> prompts; retrieval references -> ranked citations -> JSON.

Everything per query is bounded by the number of hits kept for it (top-k), so the ordered
``collect_list`` per query never grows with the index.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import base64url, url_hex

# Separator between formatted sources, and the two prompt templates of the
# retrieval walkthrough (the second drops the citation sentence).
SOURCE_SEPARATOR = "=================\n"
GROUNDED_PROMPT = """
    You are an AI assistant that helps users learn from the information found in the source material.
    Answer the query using only the sources provided below.
    Use bullets if the answer has multiple points.
    If the answer is longer than 3 sentences, provide a summary.
    Answer ONLY with the facts listed in the list of sources below. Cite your source when you answer the question
    If there isn't enough information below, say you don't know.
    Do not generate answers that don't use the sources below.
    Query: {query}
    Sources:\n{sources}
    """
GROUNDED_PROMPT_SEMANTIC = """
    You are an AI assistant that helps users learn from the information found in the source material.
    Answer the query using only the sources provided below.
    Use bullets if the answer has multiple points.
    If the answer is longer than 3 sentences, provide a summary.
    Answer ONLY with the facts listed in the list of sources below.
    If there isn't enough information below, say you don't know.
    Do not generate answers that don't use the sources below.
    Query: {query}
    Sources:\n{sources}
    """
CITATION_REF_PREFIX = "mcp://searchindex/"
CITATION_REF_PATTERN = r"^mcp://searchindex/[0-9a-fA-F]+_(.+)_pages_(\d+)$"


def py_str_repr(s: Column) -> Column:
    """Python's ``repr`` of a plain string: single quotes, unless the text has a single quote and no
    double quote; backslashes and the chosen quote are escaped."""
    esc = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    use_double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
    return F.when(use_double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def py_list_repr(arr: Column) -> Column:
    """``['a', 'b']`` as Python prints a list of strings (``None`` for a null list)."""
    inner = F.array_join(F.transform(arr, lambda x: F.coalesce(py_str_repr(x), F.lit("None"))), ", ")
    return F.when(arr.isNull(), F.lit("None")).otherwise(F.concat(F.lit("["), inner, F.lit("]")))


def format_sources(hits: DataFrame, group: str = "query_id", order: str = "rank") -> DataFrame:
    """Per query: ``TITLE: …, CONTENT: …, LOCATIONS: [...]`` for each hit in rank order, joined with
    the separator (between items only)."""
    item = F.concat(
        F.lit("TITLE: "), F.coalesce(F.col("title"), F.lit("None")),
        F.lit(", CONTENT: "), F.coalesce(F.col("chunk"), F.lit("None")),
        F.lit(", LOCATIONS: "), py_list_repr(F.col("locations")),
    )
    per = hits.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("s")))).alias("items"))
    return per.select(group, F.array_join(F.transform("items", lambda x: x["s"]), SOURCE_SEPARATOR).alias("sources"))


def _template_parts(template: str) -> list[str | tuple[str]]:
    """Split a ``str.format`` template into literal pieces and ``(field,)`` placeholders."""
    parts: list = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(template[pos:m.start()])
        parts.append((m.group(1),))
        pos = m.end()
    parts.append(template[pos:])
    return parts


def render_prompt(df: DataFrame, template: str = GROUNDED_PROMPT, fields: dict[str, str] | None = None, out_col: str = "prompt") -> DataFrame:
    """Fill ``{query}``/``{sources}`` (or any ``{name}`` in ``fields``: name -> column) in one pass,
    like ``str.format``: values are never re-scanned for placeholders."""
    fields = fields or {"query": "query_text", "sources": "sources"}
    pieces = [F.lit(p) if isinstance(p, str) else F.coalesce(F.col(fields[p[0]]), F.lit("None")) for p in _template_parts(template)]
    return df.withColumn(out_col, F.concat(*pieces))


def flatten_passages(df: DataFrame, response_col: str = "response", sep: str = "\n\n") -> DataFrame:
    """messages -> content parts -> non-empty text, joined with a blank line (row-local, no shuffle)."""
    texts = F.flatten(F.transform(F.col(response_col), lambda m: F.transform(F.coalesce(m["content"], F.array()), lambda c: c["text"])))
    keep = F.filter(texts, lambda t: t.isNotNull() & (t != F.lit("")))
    others = [c for c in df.columns if c != response_col]
    return df.select(*others, F.array_join(keep, sep).alias("content"))


# The fields of a citation.
CITATION_FIELDS = ["source_url", "source_file_name", "title", "doc_key", "reranker_score"]


def extract_citations(refs: DataFrame, group: str = "query_id", refs_col: str = "references") -> DataFrame:
    """references -> one row per reference ``(group, ord, source_url, source_file_name, title, doc_key,
    reranker_score)``; missing fields are null.  ``ord`` keeps the input order (0-based)."""
    ex = refs.select(group, F.posexplode_outer(refs_col).alias("ord", "r"))
    return ex.select(
        group,
        "ord",
        F.col("r.source_data.source_url").alias("source_url"),
        F.col("r.source_data.source_file_name").alias("source_file_name"),
        F.col("r.source_data.title").alias("title"),
        F.col("r.doc_key").alias("doc_key"),
        F.col("r.reranker_score").alias("reranker_score"),
    ).where(F.col("ord").isNotNull())


def rank_citations(cites: DataFrame, group: str = "query_id", top: int = 5) -> DataFrame:
    """Order by score desc (null counts as 0, ties keep input order), keep the best per URL (a null
    URL is one value), then the first ``top``.  Both windows keep a bounded number of rows per
    group before their shuffle (``WindowGroupLimit``)."""
    score = F.coalesce(F.col("reranker_score"), F.lit(0.0))
    best = cites.withColumn("_s", score).withColumn(
        "_u", F.row_number().over(Window.partitionBy(group, "source_url").orderBy(F.desc("_s"), F.asc("ord")))
    ).where(F.col("_u") == 1)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_s"), F.asc("ord")))).where(F.col("rank") <= top)
    return ranked.select(group, "rank", *CITATION_FIELDS)


def grounding_json(content: DataFrame, citations: DataFrame, group: str = "query_id", content_col: str = "content") -> DataFrame:
    """``{"content": ..., "citations": [...]}`` per group as a JSON string; null fields are kept."""
    cits = citations.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), F.struct(*CITATION_FIELDS).alias("c")))).alias("a")
    ).select(group, F.transform("a", lambda x: x["c"]).alias("citations"))
    joined = content.join(cits, group, "left").withColumn("citations", F.coalesce("citations", F.array().cast(cits.schema["citations"].dataType)))
    return joined.select(
        group, F.to_json(F.struct(F.col(content_col).alias("content"), "citations"), {"ignoreNullFields": "false"}).alias("json")
    )


def citation_ref(url: Column, page: Column) -> Column:
    return F.concat(F.lit(CITATION_REF_PREFIX), url_hex(url), F.lit("_"), base64url(url), F.lit("_pages_"), page.cast("string"))


def decode_citation_ref(ref: Column) -> tuple[Column, Column]:
    """``mcp://searchindex/<hex>_<base64url(url)>_pages_<n>`` -> ``(source_url, page)``, else nulls.

    Re-pads the payload, decodes URL-safe base64 strictly (invalid -> null), replaces invalid
    UTF-8, strips trailing CR/LF/TAB/space, and requires an http(s) URL.  Page stays a string.
    """
    matched = ref.rlike(CITATION_REF_PATTERN)
    b64 = F.translate(F.regexp_extract(ref, CITATION_REF_PATTERN, 1), "-_", "+/")
    padded = F.concat(b64, F.repeat(F.lit("="), (F.lit(4) - F.length(b64) % 4) % 4))
    raw = F.try_to_binary(padded, F.lit("base64"))
    text = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"[\r\n\t ]+$", "")
    ok = matched & raw.isNotNull() & (text.startswith("http://") | text.startswith("https://"))
    ok = F.coalesce(ok, F.lit(False))
    return F.when(ok, text), F.when(ok, F.regexp_extract(ref, CITATION_REF_PATTERN, 2))
